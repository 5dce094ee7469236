"""Line dedup, source mixing, the pipeline, and the SQL of the folder's queries."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filmloom.llm import line_dedup, mixing
from filmloom.llm.queries import ORACLES, QUERIES
from tests.llm.cases import COPY, LONG, ODD, SCHEMA, SPACED, lower

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, of(df, *columns))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", ["op9_source_mixing", "op10_line_dedup"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# ---- lines

def plain_lines(docs):
    held = defaultdict(set)
    key = lambda line: lower(line).strip(BLANKS)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and d is not None:
                held[key(line)].add(d)
    last = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    return [(d, [x for x in (t or "").split("\n") if d is None or d >= last.get(key(x), d)], len((t or "").split("\n"))) for d, t in docs]


def test_lines_agree_with_a_plain_version(spark):
    many = "\n".join(f"a long enough line number {i}" for i in range(200))
    docs = [(i, f"\t A LINE of more than twenty characters \x0b\nshort\nown line of document {i} here\r\nÄÖÜ äöü ßßß ñññ ééé èèè") for i in range(5)]
    docs += [(9, many), (8, many + "\nshort"), (7, many + "\n"), (7, "a long enough line number 5\n" * 3), (None, docs[0][1]), (20, None), (21, ""), (22, "\n\n"), (9, many)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h1", F.lit(1)).withColumn("pos", F.lit("x"))
    found = of(line_dedup.with_kept_lines(df, "kept", "lines"), "doc_id", "kept", "lines")
    assert sorted(((d, k, len(x)) for d, k, x in found), key=repr) == sorted(plain_lines(docs), key=repr)


def test_deduplicated_keeps_columns(spark, odd, empty):
    out = line_dedup.deduplicated(odd)
    assert out.schema.names == odd.schema.names and out.count() == len(ODD)
    found = sorted(of(out, "doc_id", "text", "n_chars"), key=repr)
    # COPY is in documents 1, 2 and 10 (3 has another line, the null id does not count); 10 is the largest.
    expected = sorted([(r[0], "" if r[0] in (1, 2) else r[1], 0 if r[0] in (1, 2) else r[4]) for r in ODD], key=repr)
    assert found == expected and line_dedup.deduplicated(empty).count() == 0


# ---- mixing

def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_sources, rest = {}, list(names), 1.5 * sum(sizes.values())
    while open_sources:
        share = rest / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if share * weight[s] > 2 * sizes[s]]
        if not full:
            target.update({s: share * weight[s] for s in open_sources})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_sources = [s for s in open_sources if s not in full]
    return target


def check_mix(rows, docs):
    sizes = Counter()
    for s, t in docs:
        sizes[s] += len(SPACED.findall(t or ""))
    target = plain_targets(sizes)
    taken = Counter()
    for source, size, source_size, goal, draws in rows:
        words = sum(d["words"] for d in draws)
        taken[source] += words
        assert source_size == sizes[source] and goal == pytest.approx(target[source]) and 0 <= words <= 2 * size
        assert len({d["pass"] for d in draws}) == len(draws) and all(d["words"] <= size for d in draws)
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 0.5 + 1e-6
    return taken


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = of(mixing.draws(docs), "doc_id", "source", "size", "source_size", "target", "draws")
    check_mix([r[1:] for r in first], of(docs, "source", "text"))
    again = of(mixing.draws(docs.repartition(7)), "doc_id", "source", "size", "source_size", "target", "draws")
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_mix_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("shard", F.lit("x"))
    rows = of(mixing.draws(docs), "source", "size", "source_size", "target", "draws")
    check_mix(rows, of(docs, "source", "text"))
    per_shard = Counter()
    for *_, draws in rows:
        for d in draws:
            per_shard[d["shard"]] += d["words"]
    assert len(per_shard) >= 8 and max(per_shard.values()) < 4 * sum(per_shard.values()) / len(per_shard)
    out = mixing.mixed(docs)
    words = Counter()
    for source, text in of(out, "source", "text"):
        words[source] += len(SPACED.findall(text))
    expected = Counter()
    for source, *_, draws in rows:
        expected[source] += sum(d["words"] for d in draws)
    assert words == expected and out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "pass", "position"]


def test_quotas_add_up_and_are_spread(spark):
    quotas = [(1, 1000), (2, 10), (3, 0), (4, 1)]
    rows = of(mixing.shard_quotas(spark.createDataFrame(quotas, "src int, blocks bigint"), 4), "shard", "src", "quota")
    per_source, per_shard = Counter(), Counter()
    for shard, src, q in rows:
        assert q >= 0
        per_source[src] += q
        per_shard[shard] += q
    assert per_source == Counter(dict(quotas)) and set(per_shard.values()) <= {63, 64} and len(per_shard) == 16


def test_hypergeometric_draws_have_their_distribution(spark):
    n = 20_000
    df = spark.range(n).select(
        mixing._hypergeometric(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(15).cast("bigint"), (F.col("id") + 0.5) / n).alias("x")
    )
    found = dict(of(df.groupBy("x").count(), "x", "count"))
    for x in range(16):
        p = math.comb(20, x) * math.comb(30, 15 - x) / math.comb(50, 15)
        assert abs(found.get(x, 0) / n - p) < 2 / n + 1e-9


def test_mix_odd_rows(spark, odd, empty):
    rows = of(mixing.draws(odd), "source", "size", "source_size", "target", "draws")
    assert len(rows) == len(ODD)
    check_mix(rows, [(r[3], r[1]) for r in ODD])
    out = of(mixing.mixed(odd), "source", "text")
    assert sum(len(SPACED.findall(t)) for _, t in out) == sum(d["words"] for r in rows for d in r[4])
    assert mixing.draws(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.draws(odd.filter("text = ''")).select("target", "source_size").distinct().collect() == [(0.0, 0)]


def test_streams_of_the_mix_stand_in_no_later_plan(spark):
    rows = spark.createDataFrame([(i, "some words here", "ab"[i % 2]) for i in range(20)], "doc_id bigint, text string, source string")
    plan = mixing.draws(rows)._jdf.queryExecution().optimizedPlan().toString()
    # Only the ranges of quotas are summed there; the windows over documents are written before.
    assert plan.count("Window [") == 1


# ---- pipeline

def write_tables(folder, docs, labels, items):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
    pq.write_table(pa.table([pa.array([d[i] for d in docs], t) for i, t in enumerate(types)], names=names), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in items], pa.int64()), "text": pa.array([x[1] for x in items], pa.string())}), f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, tmp_path, odd):
    folder = write_tables(tmp_path, ODD, [(1, 1, 0), (None, None, None)], [(1, " ".join(LONG.split()[100:130])), (None, None)])
    stage = dict(corpus_pipeline.STAGES)
    judged = stage["quality classifier"](spark, odd, folder)
    assert judged.columns == odd.columns and sorted(r[0] for r in of(judged, "doc_id") if r[0]) == [1, 10]  # one trusted document: its own perplexity is the limit, which one more character exceeds
    assert stage["line dedup"](spark, odd, folder).count() == len(ODD)
    near = stage["near-duplicate removal"](spark, odd, folder)
    assert near.columns == odd.columns
    assert sorted((r[0] for r in of(near, "doc_id")), key=repr) == sorted([1, 4, 5, 6, 7, 7, 8, 9, 11, 12, None, None], key=repr)
    clean = stage["benchmark decontamination"](spark, odd, folder)
    assert clean.columns == odd.columns and sorted(r[0] for r in of(clean, "doc_id") if r[0]) == [1, 2, 2, 3, 4, 5, 6, 7, 7, 9, 10, 11, 12]
    assert "shard" in stage["source mixing"](spark, odd, folder).columns


def test_quality_stage_tells_all_bytes_apart(spark, tmp_path):
    texts = {1: "Anna sah 12 Häuser. " * 20, 2: "Enna sah 56 Hîuser. " * 20}  # as symbols both are the same
    folder = write_tables(tmp_path, [tuple([i, text, "de"] + [None] * (len(ODD[0]) - 3)) for i, text in texts.items()], [(1, 1, 0)], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [r[0] for r in of(dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, folder), "doc_id")] == [1]


def test_stages_on_empty_tables(spark, tmp_path):
    folder = write_tables(tmp_path, [], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_pipeline_on_given_tables(spark):
    """Each stage against what it may remove, on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "line dedup":
            plain = {d: "\n".join(kept) for d, kept, _ in plain_lines([(r["doc_id"], r["text"]) for r in before.values()])}
            assert {d: r["text"] for d, r in after.items()} == plain
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    mix = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in mix.select("doc_id").distinct().collect()} <= set(after)
    copies = Counter(r["doc_id"] for r in mix.select("doc_id").collect())
    assert max(copies.values()) <= 2


def test_rounds_of_components_plan_each_table_once_or_twice(spark, monkeypatch):
    """A round's plan must not hold copies of copies: the driver keeps every plan and its code in memory."""
    from filmloom.llm import components as module

    exchanges = []

    def counted(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges.append(plan.count("Exchange hashpartitioning"))
        return write_through(df, label)

    write_through = module.write_through
    monkeypatch.setattr(module, "write_through", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (5, 5), (None, 3)], "a bigint, b bigint").repartition(4)
    got = {r["node"]: r["component"] for r in module.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert max(exchanges) <= 5, exchanges
