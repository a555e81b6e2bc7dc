"""From read documents to a plan of notes: metadata, prepared fragments, names, and what would be done to each note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import markdown as md
from notemill.functions import names, refs
from notemill.functions.names import first_line
from notemill.functions.text import compact_date, sanitize_title, sermon_id, validate_tags
from notemill.operators import relational
from notemill.plans import notes, render
from notemill.shared import checkpoint

FRAGMENTS = "map<string, array<struct<title: string, kind: string, bullets: array<string>, doctrine: array<string>, tags: array<string>>>>"


def metadata(docs: DataFrame, settings: dict, books: list[str]) -> DataFrame:
    """M1: docs (path, text) with date, yymmdd, target, kind, title, main_passage, sermon_id and refs.

    References are found and made distinct within the row, so nothing shuffles.
    """
    naming, kinds = settings["naming"], settings["sermon_kinds"]
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folders = F.slice(F.reverse(parts), 2, 3)
    named = docs.withColumn("n", names.parse_filename(stem, naming["target_markers"], folders, naming["folder_to_target"] if naming["target_from_folder"] else {}))
    title = F.when(F.col("n.title") == "untitled", first_line(F.col("text"))).otherwise(F.col("n.title"))
    kind = names.declared_kind(F.col("n.target"), folders, stem, kinds["values"], kinds["marker_to_kind"])
    known = named.select(*docs.columns, F.col("n.date").alias("date"), compact_date(F.col("n.date")).alias("yymmdd"), F.col("n.target").alias("target"), kind.alias("kind"), title.alias("title"))
    style = settings["bible"]
    one = lambda r, i: F.struct(i.alias("pos"), *[r[c].alias(c) for c in ("normalized", "status", "raw", "note")])
    whole = known.withColumn("refs", F.transform(refs.verses(F.col("text"), books, style["max_range_expand"], style["book_aliases"]), one))
    first = F.get(F.filter("refs", lambda r: r["status"] == "ok"), F.lit(0))["normalized"]
    whole = whole.withColumn("main_passage", F.coalesce(first, F.lit("")))
    return whole.withColumn("sermon_id", sermon_id(F.col("date"), F.col("title"), F.col("main_passage")))


def prepared(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, fragments), (source, n)) of chunks (name, content): JSON maps, the last chunk by name wins a source.

    The second holds sources of more than one chunk.
    """
    read = chunks.select("name", F.explode(F.from_json("content", FRAGMENTS, {"mode": "PERMISSIVE"})).alias("source", "fragments"))
    merged = relational.last_wins(read, "source", "name", "fragments")
    return merged.select("source", "fragments"), merged.where("n > 1").select("source", "n")


def usable_fragments(fragments: Column) -> Column:
    """With clean titles, bullets and tags; those without a title or bullets go. The kind is `argument` if none is given."""

    def clean(f: Column) -> Column:
        bullets = F.filter(F.transform(F.coalesce(f["bullets"], F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b != "")
        return F.struct(
            sanitize_title(f["title"], "").alias("title"),
            F.coalesce(f["kind"], F.lit("argument")).alias("kind"),
            bullets.alias("bullets"),
            f["doctrine"].alias("doctrine"),
            validate_tags(F.coalesce(f["tags"], F.array().cast("array<string>"))).alias("tags"),
        )

    return F.filter(F.transform(fragments, clean), lambda f: (f["title"] != "") & (F.size(f["bullets"]) > 0))


def dropped_fragments(fragments: Column) -> Column:
    """Positions (from 1) and reasons of the fragments that usable_fragments leaves out."""

    def why(f: Column, i: Column) -> Column:
        blank = ~F.exists(F.coalesce(f["bullets"], F.array().cast("array<string>")), lambda b: F.trim(b) != "")
        reason = F.when(sanitize_title(f["title"], "") == "", "no_title").when(blank, "no_bullets")
        return F.when(reason.isNotNull(), F.struct((i + 1).alias("pos"), reason.alias("reason")))

    return F.array_compact(F.transform(fragments, why))


def looked_up(docs: DataFrame, injected: DataFrame, value: str) -> DataFrame:
    """Docs (path, ...) with the injected (source, value) under their path or, if that has none, their file name.

    An empty list under the path counts as none. Sources are unique, so the joins add no rows.
    """
    by_path = injected.select(F.col("source").alias("path"), F.col(value).alias("_a"))
    by_name = injected.select(F.col("source").alias("_name"), F.col(value).alias("_b"))
    both = docs.join(by_path, "path", "left").withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(by_name, "_name", "left")
    return both.withColumn(value, F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b", "_name")


def axis_values(given: Column, allowed: list[str], default: Column | None = None, unknown: bool = False) -> tuple[Column, Column]:
    """P7, J1 on arrays: (values in the list's spelling, rejected values). An empty list accepts all; `default` fills an empty result.

    unknown keeps values that are not on the list as they are.
    """
    some = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda v: F.trim(md.bare(v))), lambda v: v != "")
    if not allowed:
        fill = F.when((F.size(some) == 0) & (F.trim(default) != ""), F.array(F.trim(md.bare(default)))).otherwise(F.array_distinct(some)) if default is not None else F.array_distinct(some)
        return fill, F.array().cast("array<string>")
    table = F.create_map(*[x for v in allowed for x in (F.trim(md.bare(F.lit(v))), F.lit(v))])
    listed = lambda v: F.coalesce(F.try_element_at(table, v), v) if unknown else F.try_element_at(table, v)
    kept = F.array_distinct(F.array_compact(F.transform(some, listed)))
    if default is not None:
        spare = F.try_element_at(table, F.trim(md.bare(default)))
        kept = F.when((F.size(kept) == 0) & spare.isNotNull(), F.array(spare)).otherwise(kept)
    return kept, F.filter(some, lambda v: F.try_element_at(table, v).isNull()) if not unknown else F.array().cast("array<string>")


AXES = ["world", "outcome", "route", "doctrine"]
WORD = "struct<world: array<string>, outcome: array<string>, route: array<string>, doctrine: array<string>, tags: array<string>>"


def classified(word: Column, kind: Column, settings: dict) -> Column:
    """Struct of the axes, tags and `rejected` (axis, value) of a document's proposed classification, a WORD or null.

    Values not on an axis' list are rejected, of doctrine only unless unknown ones are allowed. A document without a world gets the one that
    the settings name for its kind.
    """
    given, by_kind = settings["classification"], {k: v for k, v in settings["sermon_kinds"]["world_by_kind"].items() if str(v).strip()}
    default = F.coalesce(*[F.when(kind == k, F.lit(str(v))) for k, v in by_kind.items()], F.lit("")) if by_kind else None
    pairs = {a: axis_values(word[a], given[f"{a}_values"], default if a == "world" else None, a == "doctrine" and given["allow_unknown_doctrine"]) for a in AXES}

    def named(axis: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("value")))

    rejected = F.concat(*[named(a, no) for a, (_, no) in pairs.items()])
    tags = validate_tags(F.coalesce(word["tags"], F.array().cast("array<string>")))
    return F.struct(*[yes.alias(a) for a, (yes, _) in pairs.items()], tags.alias("tags"), rejected.alias("rejected"))


def _main_fields(word: Column, settings: dict, now: str | None) -> tuple[dict[str, Column], set[str], set[str]]:
    """Frontmatter of a main note: (fields in order, which are lists, which are left out when empty)."""
    given, kinds, bible = settings["classification"], settings["sermon_kinds"], settings["bible"]
    fields = {"created": F.lit(now), "modified": F.lit(now)} if now else {}
    lists, optional = {"tags", bible["frontmatter_key"]}, {"tags"}
    if given["use_word"]:
        for axis in AXES:
            fields[axis] = md.decorate(word[axis], given["wrap_values_in_wikilink"])
        lists |= set(AXES)
        if given["route_scalar"]:
            fields["route"] = F.coalesce(F.get(fields["route"], F.lit(0)), F.lit(""))
            lists -= {"route"}
    fields["tags"] = word["tags"]
    if key := kinds["frontmatter_key"].strip():
        fields[key] = F.col("kind")
        optional |= {key}
    clear = F.filter("refs", lambda r: r["status"] == "ok")
    fields[bible["frontmatter_key"]] = F.array_distinct(F.transform(clear, lambda r: refs.link(bible["link_style"], r["normalized"])))
    return fields | {n: F.col(n) for n in ("sermon_id", "title", "date", "main_passage")}, lists, optional


def _fragment_fields(doctrine: Column, tags: Column, settings: dict, now: str | None) -> tuple[dict[str, Column], set[str], set[str]]:
    """Frontmatter of a fragment: the world that the settings name for fragments, its own doctrine and tags."""
    given = settings["classification"]
    fields = {"created": F.lit(now), "modified": F.lit(now)} if now else {}
    if given["use_word"]:
        if world := given["fragment_world"].strip():
            fields["world"] = md.decorate(F.array(F.lit(world)), given["wrap_values_in_wikilink"])
        fields["doctrine"] = md.decorate(axis_values(doctrine, given["doctrine_values"], None, given["allow_unknown_doctrine"])[0], given["wrap_values_in_wikilink"])
    return fields | {"tags": tags}, {"world", "doctrine", "tags"}, {"doctrine", "tags"}


def folder_for(kind: Column, folders: dict[str, str], default: str) -> Column:
    """The kind's folder, else the default one; both stay inside the vault."""
    routes = [F.when(kind == k, F.lit(names.relative_folder(f))) for k, f in folders.items() if f]
    return F.coalesce(*routes, F.lit(names.relative_folder(default)))


def done_before(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, sermon ids) that logs (source, sermon_id, action) name; conflicts that were skipped are offered again."""
    done = log.where("action != 'skip_conflict'")
    return done.select(F.col("source").alias("path")).distinct(), done.where("sermon_id != ''").select("sermon_id").distinct()


def plan(meta: DataFrame, existing: DataFrame, settings: dict, injected: DataFrame | None = None, words: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Rows (source, kind, path, action, content, bullets, sermon_id) for the main note and the fragment notes of each document.

    meta is of metadata(); existing (path, content) are the vault's notes; words (source, word: a WORD) are proposed
    classifications, found as injected fragments are and used where the settings classify. now is written as the time of making. A document without text gives one row with the
    action `failed`. Equal names of one run get numbers, main notes and fragments apart; a fragment that exists is merged, skipped or a conflict as set.
    """
    naming, out = settings["naming"], settings["output"]
    known = looked_up(meta, injected, "fragments") if injected is not None else meta.withColumn("fragments", F.lit(None))
    if words is not None:
        known = looked_up(known, words.select("source", F.array("word").alias("_words")), "_words")
    known = known.withColumn("word", classified(F.get("_words", F.lit(0)) if words is not None else F.lit(None).cast(WORD), F.col("kind"), settings)).drop("_words")
    bare = F.array().cast("array<string>")
    shaped = lambda f, doctrine, tags: F.struct(f["title"].alias("title"), f["kind"].alias("kind"), f["bullets"].alias("bullets"), doctrine.alias("doctrine"), tags.alias("tags"))
    own = F.transform(md.fragments(F.col("text"), F.col("sermon_id")), lambda f: shaped(f, bare, bare))
    given = F.transform(usable_fragments(F.col("fragments")), lambda f: shaped(f, F.coalesce(f["doctrine"], bare), f["tags"])) if injected is not None else F.lit(None)
    read = known.where(F.col("text").isNotNull()).withColumn("parts", F.when(F.size(given) > 0, given).otherwise(own) if injected is not None else own)
    fields = {"yymmdd": F.col("yymmdd"), "title": F.col("title"), "target": F.col("target"), "kind": F.col("kind"), "main_passage": F.col("main_passage"), "passage": F.col("main_passage"), "date": F.col("date"), "sermon_id": F.col("sermon_id")}
    base = F.regexp_replace(names.note_name(naming["main_note_pattern"], fields), r"\.md$", "")
    # documents are read and parsed once; names are given to narrow rows, numbered by the written ones
    read = checkpoint(read.withColumn("stem", base)).withColumn("_id", F.monotonically_increasing_id())
    named = read.join(relational.unique_names(read.select("_id", "path", "stem"), "stem", "path", "main").select("_id", "main"), "_id")
    folder = folder_for(F.col("kind"), settings["sermon_kinds"]["folder_by_kind"], out["main_sermon_folder"])
    parts = named.select("_id", F.col("path").alias("source"), "main", F.col("sermon_id"), *[c.alias(f"_{n}") for n, c in fields.items()], F.posexplode("parts").alias("pos", "f"))
    given_name = {n: F.col(f"_{n}") for n in fields} | {"title": F.col("f.title"), "index": F.lpad((F.col("pos") + 1).cast("string"), 2, "0")}
    parts = parts.withColumn("stem", F.regexp_replace(names.note_name(naming["fragment_note_pattern"], given_name), r"\.md$", ""))
    narrow = checkpoint(parts.select("_id", "pos", "stem", F.struct("source", "pos").alias("order")))
    parts = parts.join(relational.unique_names(narrow, "stem", "order", "basename").select("_id", "pos", "basename"), ["_id", "pos"])
    sections = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", "basename", F.col("f.bullets").alias("bullets")))).alias("shown"))  # at most 20 of its own a document
    none = F.array().cast("array<struct<pos:int,normalized:string,status:string,raw:string,note:string>>")
    unclear = F.filter(F.coalesce("refs", none), lambda r: r["status"] != "ok")
    head, lists, optional = _main_fields(F.col("word"), settings, now)
    content = render.main_note(head, lists, F.col("title"), F.coalesce("shown", F.array().cast("array<struct<pos:int,basename:string,bullets:array<string>>>")), unclear, F.col("text"), optional)
    whole = named.join(sections, "_id", "left")
    mains = whole.select(F.col("path").alias("source"), F.lit("main").alias("kind"), F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), "main", F.lit(".md")).alias("path"), content.alias("content"), bare.alias("bullets"), "main", "sermon_id")
    fragment = F.concat(F.lit(names.relative_folder(out["fragment_folder"]) + "/" if out["fragment_folder"] else ""), "basename", F.lit(".md"))
    fields, lists, optional = _fragment_fields(F.col("f.doctrine"), F.col("f.tags"), settings, now)
    pieces = parts.select("source", F.lit("fragment").alias("kind"), fragment.alias("path"), render.fragment_note(fields, lists, F.col("f.bullets"), F.col("main"), optional).alias("content"), F.col("f.bullets").alias("bullets"), "main", "sermon_id")
    there = existing.groupBy("path").agg(F.min("content").alias("old"))
    met = mains.unionByName(pieces).join(there, "path", "left")
    merged = render.merge(F.col("old"), F.col("bullets"), F.col("main"))
    act = met.withColumn("m", F.when((F.col("kind") == "fragment") & F.col("old").isNotNull(), merged))
    skip = F.when(F.col("kind") == "main", F.lit(naming["collision_policy"] == "skip")).otherwise(
        F.lit(naming["fragment_collision_policy"] == "skip") | (F.lit(naming["fragment_collision_policy"] == "merge") & (F.col("m.added") == 0) & F.contains("old", render.backlink(F.col("main"))))
    )
    can_merge = (F.col("kind") == "fragment") & F.lit(naming["fragment_collision_policy"] == "merge")
    done = act.withColumn("action", notes.action(F.col("old").isNotNull(), skip, can_merge))
    rows = done.select("source", "kind", "path", "action", F.when(F.col("action") == "merge", F.col("m.content")).otherwise(F.col("content")).alias("content"), "bullets", "sermon_id")
    failed = meta.where(F.col("text").isNull()).select(F.col("path").alias("source"), F.lit("main").alias("kind"), "path", F.lit("failed").alias("action"), F.lit(None).cast("string").alias("content"), bare.alias("bullets"), "sermon_id")
    return rows.unionByName(failed)


def append_log(written: DataFrame, folder: str, run: str) -> None:
    """K2: a run's rows added to the log, a Parquet table of the shared storage; a run's name is never used twice."""
    written.withColumn("run", F.lit(run)).write.mode("errorifexists").parquet(f"{folder}/{run}")
