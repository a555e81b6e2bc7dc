"""Searches in a file listing (path, name, suffix, size, depth, mtime): folders, vaults, notes and templates.

Folders are ranked by aggregates and windows; the words that count are settings and become literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions import names
from notemill.operators.ranks import with_place
from notemill.sources.listing import skip_reason


def suffixes(types: list[str]) -> list[str]:
    """S3: declared types as suffixes."""
    return [f".{t.lower().removeprefix('.')}" for t in types]


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def leaf_of(folder: Column) -> Column:
    return F.element_at(F.split(folder, "/"), -1)


def usable(files: DataFrame, supported: list[str]) -> DataFrame:
    """Files of the supported types that are no side files."""
    return files.where(F.col("suffix").isin(*supported) & skip_reason(F.col("name"), F.col("suffix"), F.col("size")).isNull())


def sample(files: DataFrame, supported: list[str], limit: int) -> DataFrame:
    """The first `limit` usable files by path."""
    return usable(files, supported).orderBy("path").limit(limit)


def undeclared(files: DataFrame, declared: list[str]) -> DataFrame:
    """A2: how many files there are of each type that is not declared, most first."""
    return files.where(~F.col("suffix").isin(*declared)).groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "suffix")


def visible(path: Column, skipped: list[str]) -> Column:
    """No folder of the path is hidden, temporary or on the list."""
    return ~F.exists(F.split(folder_of(path), "/"), lambda p: p.startswith(".") | p.startswith("~") | p.isin(*skipped))


def folders(files: DataFrame, readable: list[str], samples: int = 6) -> DataFrame:
    """Of each folder its files, those that can be read, counts by suffix, the first names and the latest change."""
    f = files.withColumn("folder", folder_of(F.col("path")))
    counts = f.groupBy("folder", "suffix").agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("latest"))
    whole = counts.groupBy("folder").agg(
        F.sum("n").alias("documents"),
        F.coalesce(F.sum(F.when(F.col("suffix").isin(*readable), F.col("n"))), F.lit(0)).alias("readable"),
        F.map_from_entries(F.collect_list(F.struct("suffix", "n"))).alias("by_suffix"),
        F.max("latest").alias("latest_modified"),
    )
    first = f.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("name"))).where(F.col("k") <= samples)
    return whole.join(first.groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("samples")), "folder")


def folder_score(folder: Column, samples: Column, documents: Column, words: list[str]) -> Column:
    """6 for a word in the folder's name, else 3 for one in its path; 2 a sample with one; 1 for four documents, up to 5."""
    hits = F.size(F.filter(samples, lambda n: names.has_word(n, words)))
    place = F.when(names.has_word(leaf_of(folder), words), 6).when(names.has_word(folder, words), 3).otherwise(0)
    return place + 2 * hits + F.floor(F.least(documents, F.lit(20)) / 4)


def best_folders(found: DataFrame, words: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the best folders, one row with their number before the cut); those with a score under 4 and under 5 documents go."""
    scored = found.withColumn("score", folder_score(F.col("folder"), F.col("samples"), F.col("documents"), words)).where("score >= 4 or documents >= 5")
    return scored.orderBy(F.desc("score"), F.desc("documents"), "folder").limit(limit), scored.agg(F.count(F.lit(1)).alias("total"))


def vaults(files: DataFrame, marker: str = ".obsidian") -> DataFrame:
    """Folders that hold the marker folder, with the number of notes below them, most first.

    A note is joined to its own ancestors, not to all vaults.
    """
    roots = files.where(F.contains("path", F.lit(f"/{marker}/"))).select(F.split_part("path", F.lit(f"/{marker}/"), F.lit(1)).alias("vault")).distinct()
    parts = F.split("path", "/")
    notes = files.where("suffix = '.md'").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("vault"))
    return roots.join(notes.groupBy("vault").agg(F.count(F.lit(1)).alias("notes")), "vault", "left").fillna(0, ["notes"]).orderBy(F.desc("notes"), "vault")


def first_label(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule (part of the path, label) that fits."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(part)), F.lit(label)) for part, label in rules], F.lit(otherwise))


def note_folders(files: DataFrame, vault: str, skipped: list[str], depth: int = 3) -> DataFrame:
    """(folder, notes): folders of a vault, by path within it, with their own notes."""
    inside = F.substring("path", F.lit(len(vault.rstrip("/")) + 2), F.length("path"))
    own = files.where(F.startswith("path", F.lit(vault.rstrip("/") + "/"))).select(inside.alias("path"), "suffix").where(F.contains("path", F.lit("/")))
    found = own.where(visible(F.col("path"), skipped)).withColumn("folder", folder_of(F.col("path"))).where(F.size(F.split("folder", "/")) <= depth)
    return found.groupBy("folder").agg(F.count_if(F.col("suffix") == ".md").alias("notes"))


def candidates(found: DataFrame, words: list[str], limit: int, avoid: list[str] | None = None) -> DataFrame:
    """Folders by score: 3 a word in the path, 2 more in the name, less 4 for a word to avoid (which may end below 1)."""
    path, leaf = F.lower("folder"), F.lower(leaf_of(F.col("folder")))

    def points(c: Column, n: int) -> Column:
        return reduce(lambda a, w: a + F.when(F.contains(c, F.lit(w.lower())), n).otherwise(0), words, F.lit(0))

    scored = found.withColumn("score", points(path, 3) + points(leaf, 2)).where("score > 0")
    less = F.when(names.has_word(leaf_of(F.col("folder")), avoid or []), 4).otherwise(0)
    return scored.withColumn("score", F.col("score") - less).orderBy(F.desc("score"), F.desc("notes"), "folder").limit(limit)


def axis_counts(content: Column, prefixes: dict[str, str]) -> Column:
    """A10: struct of the number of links that start with each axis's prefix."""
    return F.struct(*[F.regexp_count(content, F.lit(rf"\[\[\Q{p.replace(chr(0xFE0F), '').strip()}\E")).alias(a) for a, p in prefixes.items()])


def taxonomy_notes(notes: DataFrame, prefixes: dict[str, str], least: int = 2, largest: int = 400_000) -> DataFrame:
    """Notes (path, size, content) with links of at least `least` axes."""
    counted = notes.where(F.col("size") <= largest).withColumn("axes", axis_counts(F.col("content"), prefixes))
    matched = reduce(lambda a, b: a + b, [(F.col(f"axes.{a}") > 0).cast("int") for a in prefixes])
    return counted.withColumn("matched", matched).where(F.col("matched") >= least)


def named_or_all(notes: DataFrame, words: list[str], prefixes: dict[str, str], largest: int = 200_000) -> DataFrame:
    """Taxonomy notes among those with a word in their name; only if there is none, among all."""
    named = taxonomy_notes(notes.where(names.has_word(leaf_of(F.col("path")), words)), prefixes, largest=largest)
    return taxonomy_notes(notes, prefixes, largest=largest) if named.isEmpty() else named


def capped(notes: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` notes of each folder by path."""
    order = Window.partitionBy(folder_of(F.col("path"))).orderBy("path")
    return notes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def templates(notes: DataFrame, words: list[str], keys: list[str], class_keys: list[str]) -> DataFrame:
    """Notes with a word in their name and a wanted key in their frontmatter; `classified` if they hold class fields."""
    has = notes.where(names.has_word(leaf_of(F.col("path")), words)).withColumn("keys", md.frontmatter_keys(F.col("content")))
    return has.where(F.arrays_overlap("keys", F.array(*map(F.lit, keys)))).withColumn("classified", F.arrays_overlap("keys", F.array(*map(F.lit, class_keys))))


def by_priority(*found: DataFrame) -> DataFrame:
    """One row a path, from the first of the searches that found it, with its `priority`."""
    ranked = [df.withColumn("priority", F.lit(k)) for k, df in enumerate(found)]
    whole = reduce(lambda a, b: a.unionByName(b), ranked)
    return whole.groupBy("path").agg(F.min_by(F.struct(*[c for c in whole.columns if c != "path"]), "priority").alias("r")).select("path", "r.*")


def titles(files: DataFrame, limit: int, latest: bool = False) -> DataFrame:
    """(title, path) of notes by name, or the latest first, with `truncated` if the limit cut some off.

    The cut comes from places over range partitions, so a limit of millions meets in no task.
    """
    order = [F.desc("mtime"), "path"] if latest else ["name", "path"]
    ranked = with_place(files, order, "k")
    cut = ranked.where(F.col("k") == limit).isEmpty()
    return ranked.where(F.col("k") < limit).orderBy("k").select(F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), "path", F.lit(not cut).alias("truncated"))


def chunk_titles(chunks: DataFrame) -> DataFrame:
    """(title) out of chunks (content: JSON map of source to fragments), each once; unreadable chunks give none."""
    read = F.from_json("content", "map<string, array<struct<title: string>>>", {"mode": "PERMISSIVE"})
    return chunks.select(F.explode(F.flatten(F.map_values(read))).alias("f")).select(F.trim("f.title").alias("title")).where("title != ''").distinct()


def naming(files: DataFrame) -> DataFrame:
    """A3: histogram (what, value, n) of how names are dated, which short first words they have and which kinds they name."""
    stem = names.unquoted(F.regexp_replace("name", r"\.[^.]*$", ""))
    shape = F.coalesce(*[F.when(F.col("stem").rlike(p), F.lit(f"shape_{k}")) for k, (p, _, _) in enumerate(names.DATED)], F.lit("none"))
    rest = F.coalesce(*[F.when(F.col("stem").rlike(p), F.regexp_extract("stem", p, r)) for p, _, r in names.DATED])
    marker = F.regexp_extract(rest, r"^([^\s_\-]{1,4})[\s_\-]+\S", 1)

    def one(what: str, value: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), F.coalesce(value, F.lit("")).alias("value"))

    seen = files.select(stem.alias("stem"))
    return seen.select(F.explode(F.array(one("date", shape), one("marker", marker), one("kind", names.kind_of(F.col("stem"))))).alias("x")).select("x.*").where("value != ''").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def folder_kinds(files: DataFrame) -> DataFrame:
    """A3: (name, kind) of the folders that name a kind: of each file the nearest of three parents that does, without its number."""
    parents = F.slice(F.reverse(F.split("path", "/")), 2, 3)
    named = F.transform(parents, lambda p: F.regexp_replace(p, r"^[0-9]+[.\-]?\s*", ""))
    first = F.get(F.filter(F.transform(named, lambda n: F.struct(n.alias("name"), names.kind_of(n).alias("kind"))), lambda x: x["kind"] != ""), F.lit(0))
    # folders are distinct before their names are judged
    return files.select(folder_of(F.col("path")).alias("folder")).distinct().select(F.concat("folder", F.lit("/x")).alias("path")).select(first.alias("f")).where("f IS NOT NULL").select("f.*").distinct()


def dated_share(histogram: DataFrame) -> DataFrame:
    """The commonest date shape (the first listed of equals) and its share of all names, to two digits."""
    dates = histogram.where("what = 'date'")
    some = F.when(F.col("value") != "none", F.struct(F.col("n"), -F.substring("value", 7, 2).try_cast("int")))
    return dates.agg(F.max_by("value", some).alias("shape"), F.bround(F.coalesce(F.max(F.when(F.col("value") != "none", F.col("n"))), F.lit(0)) / F.sum("n"), 2).alias("ratio"))


def decide_markers(histogram: DataFrame, kinds: list[str]) -> DataFrame:
    """Markers of one letter, seen twice or more, or of a kind that a folder confirms; most frequent first."""
    marks = histogram.where("what = 'marker'").withColumn("kind", names.marker_kind(F.col("value")))
    return marks.where((F.length("value") == 1) | (F.col("n") >= 2) | F.col("kind").isin(*kinds)).select(F.col("value").alias("token"), "kind", "n").orderBy(F.desc("n"), "token")


def suggest_naming(histogram: DataFrame, folder_kinds: dict[str, str]) -> DataFrame:
    """A5: one row of settings that fit a histogram of naming() and the kinds of folders (folder to kind).

    Columns main_note_pattern, fragment_note_pattern, target_markers (most frequent first), folder_to_target, date_from_filename,
    target_from_folder, kinds (of folders, then of markers, then of names, most frequent first), marker_to_kind. The histogram
    holds words of at most four characters and kinds, no row a file. An empty one suggests names without date and marker.
    """
    kind = F.nullif(names.marker_kind(F.col("value")), F.lit(""))
    decided = (F.col("what") == "marker") & ((F.length("value") == 1) | (F.col("n") >= 2) | F.coalesce(kind.isin(*folder_kinds.values()), F.lit(False)))
    seen = histogram.agg(
        F.array_sort(F.collect_list(F.when(decided, F.struct((-F.col("n")).alias("n"), F.col("value").alias("token"), kind.alias("kind"))))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "kind", F.struct((-F.col("n")).alias("n"), "value")))).alias("k"),
        F.coalesce(F.max((F.col("what") == "date") & (F.col("value") != "none")), F.lit(False)).alias("dated"),
    )
    # fixed values: the patterns on offer
    pattern = F.when(F.col("dated") & (F.size("m") > 0), "{yymmdd}_{target}_{title}_{main_passage}.md").when(F.col("dated"), "{yymmdd}_{title}_{main_passage}.md").otherwise("{title}_{main_passage}.md")
    known = F.filter("m", lambda x: x["kind"].isNotNull())
    of_folders = F.array(*[F.lit(k) for k in folder_kinds.values()]).cast("array<string>")
    kinds = F.array_distinct(F.concat(of_folders, known["kind"], F.col("k")["value"]))
    folder_map = F.create_map(*[F.lit(x) for kv in folder_kinds.items() for x in kv]).cast("map<string,string>")
    return seen.select(
        pattern.alias("main_note_pattern"), F.lit("{title}.md").alias("fragment_note_pattern"), F.col("m")["token"].alias("target_markers"), folder_map.alias("folder_to_target"),
        F.col("dated").alias("date_from_filename"), F.lit(bool(folder_kinds)).alias("target_from_folder"), kinds.alias("kinds"),
        F.map_from_entries(F.transform(known, lambda x: F.struct(x["token"], x["kind"]))).alias("marker_to_kind"),
    )


def naming_samples(files: DataFrame, markers: list[str], limit: int = 6) -> DataFrame:
    """A5: (name, dated, marker, title) of the first `limit` files by path, read with the markers that were decided; - for none."""
    stem = names.unquoted(F.regexp_replace("name", r"\.[^.]*$", ""))
    rest = F.coalesce(*[F.when(stem.rlike(p), F.regexp_extract(stem, p, r)) for p, _, r in names.DATED], stem)
    shown = files.orderBy("path").limit(limit).select("path", "name", F.array_max(F.array(*[stem.rlike(p) for p, _, _ in names.DATED])).alias("dated"), stem.alias("stem"), rest.alias("rest"))
    alternatives = "|".join(rf"\Q{m}\E" for m in sorted(markers, key=lambda m: (-len(m), m)))
    pattern = rf"(?s)^[\s_\-]*({alternatives})(?=[\s_\-]|$)[\s_\-]*(.*)$"
    found = F.regexp_extract("rest", pattern, 1) if markers else F.lit("")
    title = F.ltrim(F.when(found != "", F.regexp_extract("rest", pattern, 2)).otherwise(F.col("rest")) if markers else F.col("rest"), F.lit(" _-"))
    return shown.select("name", "dated", F.coalesce(F.nullif(found, F.lit("")), F.lit("-")).alias("marker"), F.coalesce(F.nullif(title, F.lit("")), F.col("stem")).alias("title")).orderBy("path")
