"""Names, notes, audits, searches, decoders and plans on small cases."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notemill.functions import markdown, names, refs
from notemill.operators import audit, gates, relational, rules
from notemill.plans import config, importing, lab, notes
from notemill.sources import decode, discovery, tables
from notemill.streaming import incremental

NOTE = '---\ncreated: 2026-01-01T10:00\nworld:\n  - "[[🌎 x]]"\n  - b\ntags: []\nroute: "[[done]]"\n  - ignored\ntitle:\n---\n- one\n* two\n\n원본: [[m]]\n'
LONG = "This is a long enough sentence of a body that goes on. And here another one follows it to be long."


def each(spark, values, *fs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", *[f(F.col("x")).alias(f"y{k}") for k, f in enumerate(fs)]).collect()
    return [tuple(r)[1:] if len(fs) > 1 else r[1] for r in sorted(rows, key=lambda r: r.i)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filenames(spark):
    got = each(spark, ["260719_대_은혜", "1004-2-3 은혜", "은혜.2026-7-19", "2026-07-19 대하여", "a+b%20c", "a%zz", "20260719 청소년 길", ""], lambda c: names.parse_filename(c, ["대", "청", "청소년"], F.array(F.lit("1. 새벽"), F.lit("x")), {"새벽": "새"}))
    assert [tuple(r) for r in got] == [
        ("2026-07-19", "대", "은혜"), ("", "새", "1004-2-3 은혜"), ("2026-07-19", "새", "은혜"), ("2026-07-19", "새", "대하여"),
        ("", "새", "a+b c"), ("", "새", "a%zz"), ("2026-07-19", "청소년", "길"), ("", "새", "untitled"),
    ]


def test_kinds_and_titles(spark):
    kinds = lambda c: names.declared_kind(F.lit(""), F.array(F.lit("a")), c, ["새벽기도회", "주일 대예배"], {"새벽": "새벽기도회", "낮": "없는 것"})
    assert each(spark, ["새벽 은혜", "은혜", "주일 대예배", "낮"], kinds) == ["새벽기도회", "", "주일 대예배", ""]
    assert each(spark, ["새", "금요 철야"], names.marker_kind) == ["새벽기도회", "금요기도회"]
    titles = ["", "계시의 필요성", "유한한 인간에게 계시는 필수다", "💡 돛 - 바람을 기다리는 사람에게", "은혜"]
    assert each(spark, titles, lambda c: names.title_issues(c, F.lit("argument"))) == [["empty"], ["length", "label"], [], [], ["length", "no_claim", "one_word"]]
    assert each(spark, ["a: b", "# x\ny", ""], names.first_line) == ["a b", "x", "untitled"]
    assert each(spark, ["a: b", ""], lambda c: names.note_name("{d}_{t}_{p}.md", {"d": F.lit("260101"), "t": c, "p": F.lit("")})) == ["260101_a b.md", "260101.md"]
    with pytest.raises(ValueError):
        names.note_name("{zz}", {})
    for bad in ("/a", "a/../b", "~/x", "C:\\x"):
        with pytest.raises(ValueError):
            names.relative_folder(bad)


def test_frontmatter(spark):
    keys, read, bullets = each(spark, [NOTE], markdown.frontmatter_keys, markdown.read_frontmatter, markdown.bullets_of)[0]
    assert keys == ["created", "world", "tags", "route", "title"]
    assert {k: (v.scalar, v["values"]) for k, v in read.items()} == {
        "created": (True, ["2026-01-01T10:00"]), "world": (False, ["[[🌎 x]]", "b"]), "tags": (False, []), "route": (True, ["[[done]]"]), "title": (False, []),
    }
    assert bullets.frontmatter == NOTE[: NOTE.index("- one")] and bullets.bullets == ["one", "two"] and bullets.trailer == "\n원본: [[m]]"
    assert each(spark, ["", "a", "2026-01-01", "[[x]]", "-a", 'c:\\u "q"', " a"], markdown.scalar) == ['""', "a", "2026-01-01", '"[[x]]"', '"-a"', '"c:\\\\u \\"q\\""', '" a"']


def test_sections_and_links(spark):
    got = each(spark, ["pre\n## A\nx\n### sub\ny\n## B \nz", "", None], lambda c: markdown.sections(c, 2), lambda c: markdown.sections(c, 2, True))
    assert [[tuple(s) for s in x] for x in got[0]] == [[("A", "\nx\n### sub\ny\n"), ("B", "\nz")], [("", "pre\n"), ("A", "\nx\n### sub\ny\n"), ("B", "\nz")]]
    assert got[1:] == [([], []), ([], [])]
    assert each(spark, ["[[🏷️ a]] [[🏷 b]] [[🏷 b]] [[c|d]]"], lambda c: markdown.prefixed_values(c, "🏷️ "), markdown.links) == [(["🏷️ a", "🏷 b"], ["🏷️ a", "🏷 b", "🏷 b", "c"])]
    assert each(spark, ["- a\n* [[b|c]]\nx\n  - d"], markdown.list_items) == [["a", "b", "d"]]
    df = spark.createDataFrame([(1, "## W\n### g1\n[[🌍 a]] [[🌍 b]]\n### g2\n[[🌍 c]]\n## D\n[[🔖x]]\n## D2\n[[🔖y]]\n## none\n")], "id int, t string")
    found = markdown.taxonomy(df, "t", {"world": "🌍", "doctrine": "🔖"}, ["id"])
    assert rows(found.select("axis", "grp", "value", "ord")) == [("doctrine", "D", "🔖x", 0), ("world", "g1", "🌍 a", 0), ("world", "g1", "🌍 b", 1), ("world", "g2", "🌍 c", 2)]


def test_fragments(spark):
    got = each(spark, [f"# H1\n{LONG}\n## H2\nshort\n---\n{LONG}", LONG, "tiny", "", None, f"a\n\n{LONG}"], lambda c: markdown.fragments(c, F.lit("id")))
    assert [[(f.title, f.kind) for f in x] for x in got] == [
        [("H1", "section"), ("This is a long enough sentence", "paragraph")], [("This is a long enough sentence", "paragraph")],
        [("id 핵심 요약", "fallback")], [], [], [("a This is a long enough senten", "paragraph")],
    ]


def test_reference_forms(spark):
    df = spark.createDataFrame([(1, "요한복음 3장 16-17절, 시 33:6, 9 시편 23편 시편 23편 요 3:18-16 요 3:18-16 시 119:1-99")], "id int, t string")
    got = refs.expand(df, "t", ["요한복음", "요", "시편", "시"], ["id"], aliases={"요한복음": "요", "시편": "시"})
    assert [(r.normalized, r.note) for r in got.orderBy("pos").collect()] == [("요3_16", ""), ("요3_17", ""), ("시33_6", ""), ("시33_9", ""), ("", "reversed"), ("", "too_long"), ("", "no_verse")]
    assert rows(refs.main_passages(got, ["id"])) == [(1, "요3_16")]


def test_audits(spark):
    body = '---\nworld:\n  - "[[🌎 x]]"\n  - b\nroute:\n  - q\ntags:\n  - a b\nk: zz\n---\n## [[nope]]\n- [[other]]\n## [[yes]]\n\n# 원본 설교문\n## [[skip]]\n'
    diagnosis = "---\nnote_type: 진단노트\n점수_본문충실: 9\n약점:\n  - zz\n검증등급: ✅2\n---\n✅\n"
    n = spark.createDataFrame([("/v/a.md", None, "create", body), ("/w/b?.md", "fragment", "merge", body), ("/v/c.md", None, "create", None), ("/v/d.md", "main", "create", diagnosis)], "path string, kind string, action string, content string")
    read = audit.fields(n)
    assert rows(audit.places(n, "/v").select("path", "rule")) == [("/v/c.md", "missing_file"), ("/w/b?.md", "forbidden_name"), ("/w/b?.md", "outside_vault")]
    assert rows(audit.classification(read, {"world": ["🌎 x"], "route": []}).select("path", "detail")) == [("/v/a.md", "b"), ("/w/b?.md", "b")]
    assert rows(audit.shape(read, {"world": ["🌎"]}).where("path = '/v/a.md'").select("rule")) == [("no_prefix_world",), ("route_is_list",), ("world_count",)]
    assert rows(audit.declared(read, "k", ["a"], F.lit("zy")).select("path", "rule")) == [("/v/a.md", "kind_not_planned"), ("/v/a.md", "kind_undeclared")]
    known = spark.createDataFrame([("yes",)], "name string")
    assert rows(audit.unresolved(read, known).select("path", "detail")) == [("/v/a.md", "nope")]
    assert rows(audit.unresolved_verses(read, "world", known)) == [(2, ["b", "🌎 x"])]
    assert rows(audit.graded(read).select("path")) == [("/v/d.md",)]
    assert audit.diagnosed(read).count() == 7
    assert rows(audit.status(audit.routed(audit.tags(read)))) == [("blocked", 1, 1)]
    one = spark.range(1)
    assert one.select(audit.score_issues(F.create_map(F.lit("a"), F.lit(3), F.lit("z"), F.lit(9)), ["a", "b"])).first()[0] == ["b", "z"]
    assert one.select(audit.bullet_issues(F.array(F.lit("**x** long enough for it")))).first()[0] == ["count"]
    assert one.select(F.lit("123456789").alias("label"), F.lit("").alias("title")).select(audit.length_issues({"label": (0, 8), "title": (0, 10)})).first()[0] == ["label"]


def test_search(spark):
    paths = ["/h/v/.obsidian/a.json", "/h/v/설교/260101_대_x.md", "/h/v/설교/260102_대_y.md", "/h/v/설교/z.txt", "/h/v/설교조각/260103 새벽 w.md", "/h/o/q.md", "/h/v/설교/~$l.md"]
    files = spark.createDataFrame([(p, p.split("/")[-1], "." + p.split(".")[-1], 5, 1, datetime(2026, 1, 1)) for p in paths], "path string, name string, suffix string, size int, depth int, mtime timestamp")
    assert [r.path for r in discovery.sample(files, [".md"], 2).collect()] == ["/h/o/q.md", paths[1]]
    assert rows(discovery.undeclared(files, [".md"])) == [(".json", 1), (".txt", 1)]
    found = discovery.folders(files, [".md"])
    best, total = discovery.best_folders(found, ["설교"], 5)
    assert rows(best.select("folder", "score", "documents", "readable")) == [("/h/v/설교", 7, 4, 3), ("/h/v/설교조각", 6, 1, 1)] and total.first().total == 2
    assert rows(discovery.vaults(files)) == [("/h/v", 4)]
    inner = discovery.note_folders(files, "/h/v", [])
    assert rows(discovery.candidates(inner, ["설교"], 5, ["조각"])) == [("설교", 3, 5), ("설교조각", 1, 1)]
    assert discovery.capped(files, 1).count() == 4
    assert rows(discovery.titles(files, 1).select("title", "truncated")) == [("260101_대_x", True)]
    histogram = discovery.naming(files)
    assert rows(discovery.dated_share(histogram)) == [("shape_0", 0.43)]
    assert rows(discovery.decide_markers(histogram, ["새벽기도회"])) == [("대", "주일대예배", 2), ("새벽", "새벽기도회", 1)]
    n = spark.createDataFrame([("/v/a.md", 10, NOTE + "[[📝 y]]")], "path string, size int, content string")
    axes = {"world": "🌎", "route": "📝"}
    assert discovery.named_or_all(n, ["zz"], axes).first().matched == 2
    assert discovery.templates(n, ["a"], ["world"], ["route"]).first().classified
    assert rows(discovery.by_priority(n.limit(0), n).select("path", "priority")) == [("/v/a.md", 1)]
    assert rows(discovery.chunk_titles(spark.createDataFrame([('{"a":[{"title":"x"}]}',), ("bad",)], "content string"))) == [("x",)]


def zipped(**files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/") + ".xml", content)
    return bytearray(raw.getvalue())


def test_extract(spark):
    docx = zipped(word__document='<w:document xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>bo</w:t><w:t>dy</w:t></w:r></w:p></w:document>')
    hwpx = zipped(Contents__section10='<s xmlns:h="u"><h:p><h:t>ten</h:t></h:p></s>', Contents__section2='<s xmlns:h="u"><h:p><h:t>two</h:t></h:p></s>')
    files = [("a", ".docx", docx), ("b", ".docx", docx), ("c", ".hwpx", hwpx), ("d", ".txt", bytearray(b"hi")), ("e", ".pdf", bytearray(b"x")), ("f", ".docx", bytearray(b"x")), ("g", ".txt", None)]
    got = {r.path: (r.text, r.error) for r in decode.extract(spark.createDataFrame(files, "path string, suffix string, content binary")).collect()}
    assert got == {"a": ("# T\nbody", None), "b": ("# T\nbody", None), "c": ("two\nten", None), "d": ("hi", None), "e": (None, "unsupported"), "f": (None, "BadZipFile"), "g": (None, "undecodable")}
    assert each(spark, ["a\f", "a\fb", "a\fb\f"], decode.pdf_pages) == [1, 2, 2]


def test_plan(spark):
    settings = config.merged({"output": {"main_sermon_folder": "notes", "fragment_folder": "fragments"}, "naming": {"main_note_pattern": "{yymmdd}_{title}_{passage}.md", "target_markers": ["대"], "fragment_collision_policy": "merge"}, "sermon_kinds": {"values": ["대예배"], "marker_to_kind": {"대": "대예배"}, "folder_by_kind": {"대예배": "big"}}})
    assert config.problems(settings) == [] and config.problems(config.merged({"safety": {"overwrite_existing": True}})) == ["safety.overwrite_existing must be false"]
    bad = {"sermon_kinds": {"enabled": True, "folder_by_kind": {"x": "../y"}}, "bible": {"link_style": "[[{verse}{nope}]]"}}
    assert len(config.problems(config.merged(bad))) == 5 and config.problems(config.merged({"naming": {"target_markers": "x"}})) == ["naming.target_markers must be a list of texts"]
    docs = spark.createDataFrame([("/x/260101_대_은혜.md", f"# H1\n요 3:16 {LONG}"), ("/y/260101_대_은혜.md", f"요 3:16 {LONG}"), ("/z/260102.md", None), ("/z/e.md", "tiny")], "path string, text string")
    meta = importing.metadata(docs, settings, ["요"])
    assert rows(meta.select("sermon_id").distinct()) == [("260101_은혜_요3_16",), ("undated_260102_no본문",), ("undated_e_no본문",)]
    chunks = [("1", '{"260101_대_은혜.md":[{"title":"a?","bullets":["x "," "]},{"title":"","bullets":["q"]}],"/x/260101_대_은혜.md":[]}'), ("2", '{"z":[]}'), ("3", "bad"), ("4", '{"z":[]}')]
    injected, repeated = importing.prepared(spark.createDataFrame(chunks, "name string, content string"))
    assert rows(repeated) == [("z", 2)]
    assert rows(injected.select(F.explode(importing.dropped_fragments(F.col("fragments")))).select("col.*")) == [(2, "no_title")]
    vault = spark.createDataFrame([("fragments/a.md", "---\nk: v\n---\n- old\n")], "path string, content string")
    plan = importing.plan(meta, vault, settings, injected)
    assert rows(plan.select("path", "action")) == [
        ("/z/260102.md", "failed"), ("big/260101_은혜_요3_16.md", "create"), ("big/260101_은혜_요3_16_02.md", "create"), ("fragments/a.md", "merge"),
        ("fragments/a_02.md", "create"), ("fragments/undated_e_no본문 핵심 요약.md", "create"), ("notes/undated_e.md", "create"),
    ]
    assert plan.where("action = 'merge'").first().content == "---\nk: v\n---\n\n- old\n- x\n\n원본 설교: [[260101_은혜_요3_16]]\n"
    assert "## [[a_02]]\n- x\n" in plan.where("path like '%_02.md' and kind = 'main'").first().content
    assert rows(notes.summarize(plan)) == [("fragment", "create", 2), ("fragment", "merge", 1), ("main", "create", 3), ("main", "failed", 1)]
    kept, rejected = importing.axis_values(F.array(F.lit("[[🏷️ a]]"), F.lit("zz")), ["🏷 a", "b"])
    assert tuple(spark.range(1).select(kept, rejected).first()) == (["🏷 a"], ["zz"])
    log = spark.createDataFrame([("a", "i", "create"), ("b", "j", "skip_conflict")], "source string, sermon_id string, action string")
    assert [rows(x) for x in importing.done_before(log)] == [[("a",)], [("i",)]]


def test_incremental(spark, tmp_path):
    def go():
        stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
        incremental.follow(stream, "k", f"{tmp_path}/log", f"{tmp_path}/cp", lambda b: b).awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/log").select("k", "v"))

    spark.range(2).selectExpr("id k", "'a' v").write.parquet(f"{tmp_path}/in")
    assert go() == [(0, "a"), (1, "a")]
    spark.range(3).selectExpr("id k", "'b' v").write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == [(0, "a"), (1, "a"), (2, "b")]


def test_rules(spark, tmp_path):
    one = spark.range(1)
    assert one.select(rules.list_issues(F.array(F.lit("d")), F.array(F.lit("믿음")), ["믿음"])).first()[0] == ["tag_count", "general_tag"]
    assert one.select(rules.list_issues(F.lit(None).cast("array<string>"), F.array(*map(F.lit, "abc")), [])).first()[0] == ["doctrine_count"]
    pairs = one.select(rules.overlapping(F.array(F.lit("aa bb cc"), F.lit("zz"), F.lit("bb cc aa")))).first()[0]
    assert [tuple(p) for p in pairs] == [(0, 2, 1.0)]
    assert each(spark, ["진단 관찰", "x"], lambda c: rules.exempt(c, ["관찰"])) == [True, False]
    plan = spark.createDataFrame([("a",), ("",), (None,)], "kind string")
    assert rows(rules.by_kind(plan, "kind")) == [("(구분 없음)", 2), ("a", 1)]
    sections = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B")], "doc int, title string")
    quotas = spark.createDataFrame([("A", 1, 1), ("B", 1, 2)], "title string, least int, most int")
    assert rows(rules.section_issues(sections, quotas)) == [(1, "A", 2, 1, 1), (1, "B", 0, 1, 2)]
    assert each(spark, ['{"text":"t"}', "raw", '["t"]'], decode.text_or_json) == ["t", "raw", '["t"]']
    assert each(spark, ['{"quotes":["a"," "]}', '["b"]', "raw"], decode.quotes_of) == [["a"], ["b"], []]
    config.save(config.merged({}), f"{tmp_path}/c/s.json")
    assert config.load(f"{tmp_path}/c/s.json") == config.DEFAULTS and config.read_json(f"{tmp_path}/none") == {}


def test_diagnosis(spark, tmp_path):
    """Every problem of a diagnosis is told; a sound one is written once and never over a note."""
    scores = dict.fromkeys(lab.DIMENSIONS, 3)
    data = [
        ("은혜: 길", "## 한 줄\n요 3:16 ✅✅", scores | {"적용구체": 2}, ["적용구체"], " 적용구체 ", {"설교노트": "a.md"}, ["두 말", "#"], None),
        ("x", "y", scores | {"적용구체": 6, "zz": 1}, ["q"], "w", None, None, None),
        (None, "## 검증 요약", None, None, None, None, None, 3),
    ]
    results = spark.createDataFrame(data, "title string, body string, scores map<string,int>, weaknesses array<string>, focus string, links map<string,string>, tags array<string>, search_count int")
    none = spark.createDataFrame([], "path string")
    planned = lab.plan(results, "diagnose", none, str(tmp_path.name), ["요"], now="2026-01-02T03:04")
    good, bad, worse = sorted(planned.collect(), key=lambda r: (r.action != "create", r.title is None))
    assert good.path == f"{tmp_path.name}/2026-01-02_진단_은혜 길.md" and good.problems == [] and good.warnings == ["tag_joined:두 말"]
    assert bad.problems == ["score:적용구체", "unknown_score:zz", "unknown_weakness:q", "unknown_focus"] and bad.content is None
    assert worse.problems == ["summary_written", "title_empty", *[f"score:{d}" for d in lab.DIMENSIONS]]
    lines = good.content.split("\n")
    assert lines[:7] == ["---", 'created: "2026-01-02T03:04"', 'modified: "2026-01-02T03:04"', 'note_type: "진단노트"', 'skill: "notemill"', 'title: "은혜 길"', 'date: "2026-01-02"']
    assert lines[7:13] == [f'점수_{d}: "{2 if d == "적용구체" else 3}"' for d in lab.DIMENSIONS]
    assert lines[13:] == ["약점:", '  - "적용구체"', '집중점검: "적용구체"', '설교노트: "[[a]]"', '검증등급: "✅2 🟡0 ⚠️0 ❓0 🚫0"', "tags:", '  - "두말"', "성경구절:", '  - "[[요3_16]]"', "---", "", "# 진단: 은혜 길", "", "## 한 줄", "요 3:16 ✅✅", ""]
    with pytest.raises(ValueError):
        lab.commit(planned, "WRITE")
    sound = planned.where("action = 'create'").withColumn("path", F.concat(F.lit(f"{tmp_path.parent}/"), "path"))
    with pytest.raises(PermissionError):
        lab.commit(sound)
    assert [r.status for r in lab.commit(sound, "WRITE").collect()] == ["written"]
    again = lab.plan(results.limit(1), "diagnose", planned.select("path"), str(tmp_path.name), ["요"], now="2026-01-02T03:04")
    assert [r.action for r in again.collect()] == ["conflict"]
    with pytest.raises(FileExistsError):
        lab.commit(again, "WRITE")
    assert lab.plan(results.limit(0), "enrich", none, "", ["요"]).collect() == []


def test_drafts(spark):
    inline = spark.createDataFrame([(" b ", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "title string, ord int")
    files = spark.createDataFrame([('{"titles": ["c", "a", " "]}', 1), ('["가", "c"]', 2)], "content string, ord int")
    got = [r.title for r in relational.load_drafts(inline, files).orderBy("draft_id").collect()]
    assert got == ["b", "a", "c", "가"]
    assert [r.title for r in relational.load_drafts(inline).orderBy("draft_id").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="a file of drafts"):
        relational.load_drafts(inline, spark.createDataFrame([("{}", 1)], "content string, ord int")).collect()


def test_subset(spark):
    data = [("world", "목양", "x", 0), ("world", "목양", "조각 1", 1), ("world", "etc", "메모", 2), ("world", "etc", "주일", 3), ("world", "etc", "none", 4), ("outcome", "o", "a", 0), ("outcome", "o", "설교 b", 1), ("route", "r", "DONE", 2), ("route", "r", "완료", 1), ("doctrine", "목양", "설교", 0)]
    got = rows(rules.subset(spark.createDataFrame([(1, *r) for r in data], "id int, axis string, grp string, value string, ord int"), ["id"]))
    assert got == [(1, "outcome", "설교 b", "recommended"), (1, "route", "완료", "recommended"), (1, "world", "x", "sermon"), (1, "world", "조각 1", "fragment"), (1, "world", "주일", "sermon")]
    assert rules.subset(spark.createDataFrame([], "id int, axis string, grp string, value string, ord int"), ["id"]).collect() == []


def test_few_types(spark):
    files = spark.createDataFrame([("a", ".md", b"abc"), ("b", ".hwpx", b"x"), ("c", ".docx", b"broken")], "path string, suffix string, content binary")
    got = {r.path: (r.text, r.error, r.chars) for r in decode.extract_few(files).collect()}
    assert got["a"] == ("abc", None, 3) and got["b"] == (None, "unsupported", None) and got["c"][0] is None and got["c"][1]


def test_naming_suggestions(spark):
    files = spark.createDataFrame([(f"{k}/{n}", n) for k, n in enumerate(["260719_새_은혜.docx", "260720_새_.md", "260721 긴말 하나.md", "제목 새벽.md"])], "path string, name string")
    histogram = discovery.naming(files)
    got = discovery.suggest_naming(histogram, {"1. 주일": "주일대예배"}).first()
    assert got.main_note_pattern == "{yymmdd}_{target}_{title}_{main_passage}.md" and got.fragment_note_pattern == "{title}.md"
    assert got.target_markers == ["새"] and got.marker_to_kind == {"새": "새벽기도회"} and got.kinds[:2] == ["주일대예배", "새벽기도회"]
    assert got.date_from_filename and got.target_from_folder and got.folder_to_target == {"1. 주일": "주일대예배"}
    bare = discovery.suggest_naming(histogram.limit(0), {}).first()
    assert (bare.main_note_pattern, bare.target_markers, bare.kinds, bare.marker_to_kind, bare.folder_to_target, bare.date_from_filename) == ("{title}_{main_passage}.md", [], [], {}, {}, False)
    assert [tuple(r) for r in discovery.naming_samples(files, ["새"]).collect()] == [("260719_새_은혜.docx", True, "새", "은혜"), ("260720_새_.md", True, "새", "260720_새_"), ("260721 긴말 하나.md", True, "-", "긴말 하나"), ("제목 새벽.md", False, "-", "제목 새벽")]
    assert discovery.naming_samples(files, []).first().marker == "-"


def test_classified_plan(spark):
    """Axes by their lists in the main note, world, doctrine and tags in the fragments, rejected values told."""
    settings = config.merged({
        "output": {"main_sermon_folder": "n", "fragment_folder": "f"}, "naming": {"main_note_pattern": "{title}.md"},
        "classification": {"use_word": True, "world_values": ["🏷 a", "b"], "outcome_values": ["o"], "route_values": ["r1", "r2"], "doctrine_values": ["d"], "allow_unknown_doctrine": True, "route_scalar": True, "wrap_values_in_wikilink": True, "fragment_world": "조각"},
        "sermon_kinds": {"values": ["k"], "marker_to_kind": {}, "world_by_kind": {"k": "b"}},
    })
    docs = spark.createDataFrame([("/k/one.md", "요 3:16 text"), ("/x/two.md", "plain")], "path string, text string")
    meta = importing.metadata(docs, settings, ["요"])
    chunks = spark.createDataFrame([("1", '{"one.md":[{"title":"t","bullets":["x"],"doctrine":["d","new"],"tags":["a b","#"]}]}')], "name string, content string")
    words = spark.createDataFrame([("one.md", (["zz"], ["o", "no"], ["r2", "r1"], ["own"], ["tag 1"]))], f"source string, word {importing.WORD}")
    plan = importing.plan(meta, spark.createDataFrame([], "path string, content string"), settings, importing.prepared(chunks)[0], words, now="2026-01-02T03:04")
    got = {r.path: r.content for r in plan.collect()}
    one = got["n/one.md"].split("\n---\n")[0]
    assert md_fields(one) == {
        "created": "2026-01-02T03:04", "modified": "2026-01-02T03:04", "world": ["[[b]]"], "outcome": ["[[o]]"], "route": "[[r2]]", "doctrine": ["[[own]]"], "tags": ["tag1"],
        "설교구분": "k", "성경구절": ["[[요3_16]]"], "sermon_id": "undated_one_요3_16", "title": "one", "date": "", "main_passage": "요3_16"}
    two = md_fields(got["n/two.md"].split("\n---\n")[0])
    assert two["world"] == [] and two["route"] == "" and "tags" not in two and "설교구분" not in two
    assert md_fields(got["f/t.md"].split("\n---\n")[0]) == {"created": "2026-01-02T03:04", "modified": "2026-01-02T03:04", "world": ["[[조각]]"], "doctrine": ["[[d]]", "[[new]]"], "tags": ["ab"]}
    assert {r.sermon_id for r in plan.collect()} == {"undated_one_요3_16", "undated_two_no본문"}
    read = meta.where("path LIKE '%one.md'").crossJoin(words.select("word")).select(importing.classified(F.col("word"), F.col("kind"), settings)["rejected"].alias("r")).first().r
    assert [tuple(r) for r in read] == [("world", "zz"), ("outcome", "no")]


def md_fields(block):
    out, key = {}, None
    for line in block.split("\n")[1:]:
        if line.startswith("  - "):
            out[key].append(line[4:].strip('"'))
        elif line.strip() == "[]":
            continue
        else:
            key, _, value = line.partition(":")
            out[key] = value.strip().strip('"') if value.strip() else []
    return out


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"comment": "x", "chapters": {"요": 21, "유": 1}}')
    (tmp_path / "p.json").write_text('{"patterns": [{"pattern": "a+", "reason": "r"}]}')
    (tmp_path / "d.json").write_text('{"suffixes": [".ac.uk", ".edu"], "domains": ["jstor.org"], "wiki_domains": ["wikipedia.org"]}')
    assert rows(tables.book_bounds(spark, f"{tmp_path}/b.json")) == [("요", 21), ("유", 1)]
    assert rows(tables.phrase_rules(spark, f"{tmp_path}/p.json")) == [(0, "a+", "r")]
    table = tables.domain_table(spark, f"{tmp_path}/d.json")
    hosts = spark.createDataFrame([(h,) for h in ["edu", "mit.edu", "a.b.ac.uk", "ac.uk", "xac.uk", "jstor.org", "www2.jstor.org", "myjstor.org", "ko.wikipedia.org", "", None, "mit.edu"]], "h string")
    kinds = {r.h: r.kinds for r in gates.domain_kinds(hosts, "h", table).collect()}
    assert {h for h, k in kinds.items() if k == ["institutional"]} == {"mit.edu", "a.b.ac.uk", "jstor.org", "www2.jstor.org"} and kinds["ko.wikipedia.org"] == ["wiki"] and len(kinds) == 10
    claims = spark.createDataFrame([(1, [("jstor.org", None, True), ("", "https://www.jstor.org/x", True), ("ko.wikipedia.org", None, True)]), (2, [("x.com", None, True), ("mit.edu", None, False)]), (3, None)], f"id int, evidence {gates.EVIDENCE}")
    assert rows(gates.confirmed_by(claims, "id", table)) == [(1, 1, True), (2, 1, False)]
