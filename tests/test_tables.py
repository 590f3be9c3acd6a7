"""Versioned tables, schemas, readers, mappers, the pipeline and streaming ingestion."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass import schemas
from canvass.functions.embedding import MockBackend, embed
from canvass.plans import pipeline
from canvass.sources import mappers, readers, reports, tables
from canvass.sources.tables import SchemaChange, Table
from canvass.streaming import ingest

# Workers don't know this module; what it defines goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", ("k",), T.StructType.fromDDL("k int, v string"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k int, v string")


def held(table):
    return sorted((r.k, r.v) for r in table.read().collect())


def test_merge(spark, table):
    assert held(table) == [] and table.version() is None
    assert table.merge(rows(spark, (1, "a"), (2, "b"))) == {"inserted": 2, "updated": 0}
    assert table.merge(rows(spark, (2, "c"), (3, "d"))) == {"inserted": 1, "updated": 1}
    assert held(table) == [(1, "a"), (2, "c"), (3, "d")]
    assert table.merge(spark.createDataFrame([], "k int, v string")) == {"inserted": 0, "updated": 0}
    assert table.merge(rows(spark, (2, "c"))) == {"inserted": 0, "updated": 1} and len(held(table)) == 3
    with pytest.raises(ValueError, match="more than once"):
        table.merge(rows(spark, (9, "x"), (9, "y")))
    assert table.history().where("current").count() == 1


def test_scope_and_delete(spark, table):
    assert table.delete(F.col("k") > 0) == 0
    table.merge(rows(spark, (1, "a"), (2, "b"), (3, None)))
    assert table.replace_scope(rows(spark, (7, "z")), F.col("v") == "a") == 1
    assert sorted(k for k, _ in [(r.k, r.v) for r in table.read().collect()]) == [2, 3, 7]
    assert table.delete(F.col("k") == 2) == 1
    assert table.replace_scope(spark.createDataFrame([], "k int, v string"), F.col("k") == 7) == 1
    assert [k for k, _ in held(table)] == [3]


def test_schema_changes(spark, table):
    table.merge(rows(spark, (1, "a")))
    wider = T.StructType.fromDDL("k int, v string, n bigint")
    assert table.ensure_schema(wider) and not table.ensure_schema(wider)
    assert table.read().first().n is None
    for bad in ("k int, n bigint", "k string, v string, n bigint", "k int, v string, n bigint, z int not null"):
        with pytest.raises(SchemaChange):
            table.ensure_schema(T.StructType.fromDDL(bad))
    assert table.ensure_schema(T.StructType.fromDDL("k int, n bigint"), allow_dropped=True) and table.read().columns == ["k", "n", "v"]
    with pytest.raises(SchemaChange):
        table.ensure_schema(T.StructType.fromDDL("k int, v string, n bigint, m int"), allow_added=False)


@pytest.mark.parametrize("step", ["write", "create", "stream"])
def test_a_write_that_fails_leaves_the_version_before_it(spark, table, monkeypatch, step):
    table.merge(rows(spark, (1, "a"), (2, "b")))
    fs = table._fs

    class Broken:
        def __getattr__(self, name):
            return getattr(fs, name)

        def create(self, path, overwrite):
            if step == "create":
                raise OSError("no")
            stream = fs.create(path, overwrite)
            stream.write(b'{"folders": [')
            stream.close()
            raise OSError("torn")

    if step == "write":
        monkeypatch.setattr(table, "_write", lambda rows: (_ for _ in ()).throw(OSError("no")))
    else:
        table._fs = Broken()
    with pytest.raises(OSError):
        table.merge(rows(spark, (3, "c")))
    monkeypatch.undo()
    table._fs = fs
    assert held(table) == [(1, "a"), (2, "b")]
    assert table.merge(rows(spark, (2, "x"), (3, "c"))) == {"inserted": 1, "updated": 1}
    assert held(table) == [(1, "a"), (2, "x"), (3, "c")]
    assert table.vacuum() >= 1 and held(table) == [(1, "a"), (2, "x"), (3, "c")] and table.history().count() == 1


def test_of_two_writers_the_second_is_told(spark, table):
    table.merge(rows(spark, (1, "a")))
    after, _ = table._head()
    table.merge(rows(spark, (2, "b")))
    with pytest.raises(tables.ConcurrentWrite):
        table._commit(after, [], table.schema)
    assert held(table) == [(1, "a"), (2, "b")]


def test_files_without_a_version_are_damage(spark, table):
    table._write(rows(spark, (1, "a")))
    for read in (table.read, lambda: table.merge(rows(spark, (2, "b"))), table.vacuum):
        with pytest.raises(tables.DamagedTable):
            read()
    assert table.vacuum(0) == 1 and held(table) == []


def test_null_keys_are_refused(spark, table):
    with pytest.raises(ValueError, match="null"):
        table.merge(rows(spark, (None, "a"), (1, "b")))


def test_partitions_that_a_write_does_not_touch_stay(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/p", ("k",), T.StructType.fromDDL("k int, v string"), partition="v")
    folders = lambda: {x.split("/")[-1]: x for x in t._head()[1]["folders"]}
    t.merge(rows(spark, (1, "a"), (2, "b/c"), (3, None), (4, "d")))
    before = folders()
    assert t.merge(rows(spark, (5, "a"), (4, "a"))) == {"inserted": 1, "updated": 1}  # a key that moves takes its old folder along
    after = folders()
    assert held(t) == [(1, "a"), (2, "b/c"), (3, None), (4, "a"), (5, "a")] or sorted(held(t), key=str) == sorted([(1, "a"), (2, "b/c"), (3, None), (4, "a"), (5, "a")], key=str)
    assert {k for k in before if after.get(k) == before[k]} == {"__folder=b%2Fc", "__folder=__HIVE_DEFAULT_PARTITION__"}
    assert t.delete(F.col("k") == 2, ["b/c"]) == 1 and folders()["__folder=a"] == after["__folder=a"]
    assert t.replace_scope(rows(spark, (9, "a")), F.col("v") == "a", ["a"]) == 3
    assert sorted(r.k for r in t.read().collect()) == [3, 9]
    assert t.vacuum() >= 2 and sorted(r.k for r in t.read().collect()) == [3, 9]
    m = t.metadata().first()
    assert m.partition == "v" and m.num_files >= 2 and m.size_in_bytes > 0 and json.loads(m.columns) == ["k", "v"]
    whole = Table(spark, t.path, ("k",))  # without partitions everything is rewritten
    whole.merge(rows(spark, (9, "z")))
    assert sorted(map(str, held(t))) == sorted(map(str, [(3, None), (9, "z")])) and t.merge(rows(spark, (3, "q")))["updated"] == 1


def test_versions_changes_and_metadata(spark, table):
    assert table.create() and not table.create() and table.version() == 0
    table.merge(rows(spark, (1, "a"), (2, None), (3, "c")))
    table.merge(rows(spark, (1, "x"), (2, None), (4, "d")))
    table.delete(F.col("k") == 3)
    feed = ingest.changes(table.read(1), table.read(), ("k",))
    assert sorted((r.k, r.v, r.change) for r in feed.collect()) == [(1, "x", "update"), (3, "c", "delete"), (4, "d", "insert")]
    index = {}

    def apply(feed):
        for r in feed.collect():
            index.pop(r.k, None) if r.change == "delete" else index.update({r.k: r.v})

    seen = ingest.sync(table, None, apply)
    table.merge(rows(spark, (7, "z")))
    assert ingest.sync(table, seen, apply) == table.version() == 4 and index == {1: "x", 2: None, 4: "d", 7: "z"}
    m = table.metadata().first()
    assert (m.version, m.first_version, m.versions, m.contiguous) == (4, 0, 5, True)
    assert tables.tables_of(spark, table.path + "-none").where("version is null").count() == len(schemas.KEYS)
    assert table.delete_keys(spark.createDataFrame([(7,), (1,)], "k int"), F.col("v") == "z") == 1
    rows(spark, (4, "e")).createOrReplaceTempView("fresh")
    assert table.merge_view("fresh")["updated"] == 1
    assert tables.backfill_table(table, "v", "none") == {"rows": 3, "before": 1, "after": 0} and tables.backfill_table(table, "v", "none")["before"] == 0


def test_partial_updates_exports_and_views(spark, tmp_path):
    r = rows(spark, (1, "a"), (2, "b")).withColumn("at", F.lit("old"))
    got = tables.partial_update(r, F.col("k") == 2, {"v": F.lit("z")}, ("v",), "at", F.lit("new"))
    assert [tuple(x) for x in got.collect()] == [(1, "a", "old"), (2, "z", "new")]
    with pytest.raises(ValueError, match="at"):
        tables.partial_update(r, F.col("k") == 2, {"at": F.lit("z")}, ("v",))
    path = f"file://{tmp_path}/shared"
    assert tables.replace_in_export(rows(spark, (1, "D/1"), (2, "D/1")), path, "D/1", "v") == {"deleted": 0, "inserted": 2}
    assert tables.replace_in_export(rows(spark, (5, "E")), path, "E", "v") == {"deleted": 0, "inserted": 1}
    assert tables.replace_in_export(rows(spark, (3, "D/1")), path, "D/1", "v") == {"deleted": 2, "inserted": 1}
    assert tables.replace_in_export(rows(spark, (3, "D/1")).limit(0), path, "D/1", "v") == {"deleted": 1, "inserted": 0}
    with pytest.raises(ValueError):
        tables.replace_in_export(rows(spark, (3, "x")), path, "E", "v")
    assert [x.k for x in spark.read.parquet(path).collect()] == [5]
    assert tables.view_over(spark, path, "shared_view") and spark.table("shared_view").count() == 1
    assert not tables.view_over(spark, path + "-none", "none", strict=False)
    with pytest.raises(FileNotFoundError):
        tables.view_over(spark, path + "-none", "none")


def test_reports(spark, tmp_path):
    r = rows(spark, (1, "a|b"), (2, None))
    for kind, want in (("json", json.dumps([{"k": 1, "v": "a|b"}, {"k": 2, "v": None}], indent=2) + "\n"), ("csv", "k,v\n1,a|b\n2,\n"),
                       ("md", "# T\n\n| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n")):
        reports.write_report(r.orderBy("k"), f"file://{tmp_path}/r.{kind}", "T")
        assert (tmp_path / f"r.{kind}").read_text() == want
    with pytest.raises(ValueError):
        reports.write_report(r, f"file://{tmp_path}/r.xls")


def test_export_and_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    tables.export(rows(spark, (1, "a")), path)
    with pytest.raises(Exception, match="exists"):
        tables.export(rows(spark, (2, "b")), path)
    tables.export(rows(spark, (2, "b")), path, overwrite=True)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "b")]
    by = f"file://{tmp_path}/by"
    tables.replace_partitions(rows(spark, (1, "a"), (2, "b")), by, "v")
    tables.replace_partitions(rows(spark, (3, "b")), by, "v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(by).collect()) == [(1, "a"), (3, "b")]


def test_contracts():
    for name, keys in schemas.KEYS.items():
        assert set(keys) <= set(schemas.schema(name).names)
    assert len(schemas.schema("raw_comments")) == 23 and len(schemas.schema("rule_migrations")) == 16


def test_readers(spark, tmp_path):
    r = spark.createDataFrame([(1, 0.92, "a"), (2, 0.5, "b")], "k int, t double, s string")
    assert readers.scan(r, ["k"], (("t", 0.92 + 1e-12),)).collect()[0].k == 1
    assert readers.scan(r, None, (("zz", 1),)).count() == 0 and readers.scan(r, None, (("zz", 1),), "ignore").count() == 2
    (tmp_path / "seed.json").write_text(json.dumps({"docket_id": "D", "sources": [{"entity_name": "Acme", "entity_type": "odd", "template_phrases": ["a b", "c"]}, {"entity_name": " ", "template_phrases": ["x"]}]}, indent=1))
    found = readers.seed_registry(spark, f"file://{tmp_path}/seed.json").collect()
    assert [(x.entity_name, x.entity_type, x.ord, x.phrase) for x in found] == [("Acme", "other", 0, "a b"), ("Acme", "other", 1, "c")]
    (tmp_path / "none.json").write_text('{"docket_id": "D"}')
    with pytest.raises(Exception, match="no sources"):
        readers.seed_registry(spark, f"file://{tmp_path}/none.json").collect()
    (tmp_path / "rule_1.txt").write_text("# c\n## One\nbody\n")
    text = readers.rule_text(spark, f"file://{tmp_path}/rule_1.txt")
    assert [(x.document_id, x.section, x.body) for x in readers.rule_sections(text).collect()] == [("rule_1", "One", "body")]
    good = {"docket_id": "D", "source": "ecfs", "topic_id": "t", "agency_id": "FCC", "title": "T"}
    assert readers.docket_registry(spark, [good]).count() == 1
    for bad in ([good, good], [good | {"source": "mail"}], [good | {"title": ""}]):
        with pytest.raises(ValueError):
            readers.docket_registry(spark, bad)
    assert readers.first_existing(spark, [f"file://{tmp_path}/no", "file:///root/testdata/sf0.001/nation.parquet"]).count() == 25
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [f"file://{tmp_path}/no"])


DOCKETS = """
# the list
dockets:
  - docket_id: "D-1"
    source: regulations_gov
    topic_id: labor
    agency_id: DOL
    title: 'A title: with a colon'
    date_window:
      start_date: 2024-01-01
      end_date: null
    expected_scale: 500
  - docket_id: D-2
    source: ecfs
    topic_id: tech
    agency_id: FCC
    title: Other
    notes:
"""


def test_docket_files(spark, tmp_path):
    entries = readers.docket_list(DOCKETS)
    assert entries[0]["title"] == "A title: with a colon" and entries[0]["expected_scale"] == 500 and entries[1]["notes"] is None
    (tmp_path / "d.yaml").write_text(DOCKETS)
    got = {r.docket_id: (r.source, r.start_date, r.end_date) for r in readers.docket_file(spark, f"file://{tmp_path}/d.yaml").collect()}
    assert got == {"D-1": ("regulations_gov", "2024-01-01", None), "D-2": ("ecfs", None, None)}


def test_text_decision(spark):
    r = spark.createDataFrame([("Body text", "T", False), (" ", "T", False), (None, None, True), ("See attached", "T", True)], "body string, title string, has_attachments boolean")
    got = [(x.text_source, x.parse_status, x.char_count, x.is_cover_note) for x in mappers.text_decision(r).collect()]
    assert got == [("detail_comment_text", "parsed", 9, False), ("title_only", "title_only", 1, False), ("missing", "missing_text", 0, False), ("detail_cover_note", "parsed", 12, True)]


def _raw(spark, texts):
    given = [(f"c{i}", "D", t) for i, t in enumerate(texts)]
    return tables.coerce(spark.createDataFrame(given, "comment_id string, docket_id string, comment_text string"), schemas.schema("raw_comments"))


def test_pipeline_runs_twice_alike(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    Table.named(spark, root, "raw_comments").merge(_raw(spark, ["Please support the plan now", "please  support the plan NOW", "Something else", None]))
    given = [(f"c{i}", "D", "model", 2, "h", "comment_text", v, "local") for i, v in enumerate([[1.0, 0.0], [0.99, 0.01], [0.0, 1.0]])]
    embedded = spark.createDataFrame(given, "comment_id string, docket_id string, embedding_model string, embedding_dim long, text_hash string, text_source string, embedding_vector array<float>, backend string")
    Table.named(spark, root, "comment_embeddings").merge(tables.coerce(embedded, schemas.schema("comment_embeddings")))
    registry = spark.createDataFrame([("Acme", "support the plan", 0)], "entity_name string, phrase string, ord int")
    settings = lambda: pipeline.Settings(root, "D", "2024-01-01", registry=registry, blocks=2)
    first = pipeline.run(spark, settings())
    assert first == {"parse": 4, "exact": 1, "cluster": 1, "attribute": 2, "export": 4}
    state = lambda n: sorted(map(str, Table.named(spark, root, n).read().collect()))
    names = ("parsed_comments", "comment_clusters", "comment_cluster_memberships", "campaign_attributions")
    before = [state(n) for n in names]
    again = pipeline.run(spark, settings())
    assert again["parse"] == 0 and [state(n) for n in names] == before
    assert spark.read.parquet(f"{root}/cluster_review_export/D").where("is_representative").count() == 2
    with pytest.raises(ValueError):
        pipeline.Settings(root, "D", "2024-01-01", stages=("fly",))


def test_pipeline_embeds_and_finds_phrases_in_rules(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    text = "The agency must withdraw the proposed methane fee for small wells. Other words follow here."
    Table.named(spark, root, "raw_comments").merge(_raw(spark, [text, text.upper(), "Something else", None]))
    rules = spark.createDataFrame([(0, "One", "Preamble only."), (1, "Two", "We agree. The agency must withdraw the proposed methane fee for small wells.")], "ord int, section string, body string")
    settings = pipeline.Settings(root, "D", "2024-01-01", embedding_model="mock", backend=MockBackend(16), allow_mock=True, rules=rules, rule_document_id="R",
                                 neighbours=3, stages=("parse", "embed", "exact", "cluster", "migrate"))
    assert pipeline.run(spark, settings) == {"parse": 4, "embed": 3, "exact": 1, "cluster": 1, "migrate": 2}
    settings.done = {}
    assert pipeline.run(spark, settings)["embed"] == 0
    found = Table.named(spark, root, "rule_migrations").read().collect()
    assert {(r.final_rule_section, r.similarity_score, r.final_rule_document_id) for r in found} == {("Two", 1.0, "R")}


class Bad(MockBackend):
    def encode(self, texts):
        return [[0.0] * self.dimension for _ in texts]


def test_backends(spark):
    r = spark.createDataFrame([("a",), (None,), (" ",), ("b",)] * 50, "t string")
    got = [x.v for x in r.select(embed(MockBackend(8), 7)("t").alias("v")).collect()]
    assert [v is None for v in got[:4]] == [False, True, True, False] and got[0] == got[4] and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    with pytest.raises(Exception, match="finite"):
        r.select(embed(Bad(8))("t").alias("v")).collect()


def test_streaming_ingest(spark, tmp_path):
    land, root, mark = tmp_path / "land", f"file://{tmp_path}/lake", f"file://{tmp_path}/mark"
    land.mkdir()
    page = lambda i, title, at: json.dumps({"id": f"c{i}", "type": "comments", "attributes": {"title": title, "lastModifiedDate": at, "comment": "x"}})
    (land / "1.json").write_text(page(1, "old", "2024-01-01T00:00:00Z") + "\n" + page(2, "two", "2024-01-01T00:00:00Z") + "\n")

    def go():
        q = ingest.ingest(spark, f"file://{land}", root, "D", "regulations_gov", "2024-02-01", mark)
        q.awaitTermination(120)
        return {r.comment_id: r.title for r in Table.named(spark, root, "raw_comments").read().collect()}

    assert go() == {"c1": "old", "c2": "two"}
    (land / "2.json").write_text(page(1, "new", "2024-01-02T00:00:00Z") + "\n" + page(1, "old", "2024-01-01T00:00:00Z") + "\n")
    assert go() == {"c1": "new", "c2": "two"} and go() == {"c1": "new", "c2": "two"}
