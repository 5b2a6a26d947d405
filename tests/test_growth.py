"""Findings of the third round: results and steps that only larger or emptier tables show."""

import os
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.functions.text import epoch_ms_date
from eoframe.llm import common, mixing, simhash, toxicity
from eoframe.operators import grid as gr
from eoframe.operators import ranks, seasonal
from eoframe.plans import run_queries
from eoframe.plans.catalogue import RUNS, SQL
from eoframe.plans.views import TABLES
from eoframe.session import stable
from eoframe.sources.pixels import read_kml_corpus
from eoframe.streaming import intake
from oracle import SMALL, compare, connect


def _tables(folder, **changed):
    """The small tables with some of them replaced by a query over the old one."""
    con = duckdb.connect()
    for name in TABLES:
        source = f"'{SMALL}/{name}.parquet'"
        if name in changed:
            con.execute(f"COPY ({changed[name].format(source)}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


def test_dates_beyond_the_year_9999(spark, tmp_path):
    folder = _tables(tmp_path, events="SELECT * REPLACE (event_id + 5000000 AS event_id) FROM {}")
    assert compare(RUNS["epoch_ms_date"](spark, folder), connect(folder), SQL["epoch_ms_date"]) == ""
    days = spark.createDataFrame([("740740734000000",), ("-1000",), ("",)], "v string").select(epoch_ms_date(F.col("v")).alias("d"))
    assert [r.d for r in days.collect()] == ["25443-02-21", "1969-12-31", "—"]


def test_shares_of_no_pixel(spark, tmp_path):
    folder = _tables(tmp_path, lineitem="SELECT * FROM {} WHERE false")
    con = connect(folder)
    for name in ("optical_run_ndvi_classes", "ndvi_classes", "dnbr_classes"):
        assert compare(RUNS[name](spark, folder), con, SQL[name]) == "", name


def test_points_of_a_box_are_projected_as_columns(spark):
    boxes = spark.createDataFrame([(-84.1, 9.9, -84.0, 10.0, 32616)], "west double, south double, east double, north double, epsg int")
    plan = gr.project_bbox(boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no subexpression of a lambda function is shared


def test_tasks_of_the_amplitude_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(seasonal, "TASK_ROWS", 100)
    df = spark.range(4000).select(F.lit("NDVI").alias("index"), (F.col("id") % 300).alias("px"), (F.col("id") % 12 + 1).alias("month"), F.col("id").cast("double").alias("value"))
    amplitude = seasonal.seasonal_amplitude(df, ("index", "px"))
    plan = amplitude._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 40" in plan
    assert "Union" not in plan  # no key is hot, so the rows are read once more and not twice
    assert amplitude.count() == 300


def test_a_product_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(500).selectExpr("'a' AS index", "CAST(id AS DOUBLE) AS value").mapInPandas(rows, "index string, value double")
    assert seasonal.product_summary(df, ["index"]).first().median == 249.5
    assert seen.value == 500


def test_histograms_stay_small(spark):
    """A histogram has rows by the range of the values, few beside the rows of a large group."""
    values = spark.range(1, 100_001).select((F.col("id") / 100_000.0).alias("v"))
    assert values.select(ranks.value_bucket(F.col("v"))).distinct().count() < 1000


def test_a_corpus_of_many_texts_makes_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_queries, "scratch", lambda t, name: f"{tmp_path}/{name}")
    got = RUNS["read_kml_corpus"](spark, SMALL)
    assert compare(got, connect(SMALL), SQL["read_kml_corpus"]) == ""
    assert len([f for _, _, files in os.walk(tmp_path / "kml") for f in files if f.endswith((".parquet", ".txt"))]) <= 8


def test_a_corpus_of_files_is_read_whole(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.kml").write_text("<Placemark>\n<Placemark>\n" * i)
    docs = read_kml_corpus(spark, str(tmp_path))
    assert sorted((r.path[-5:], r.kml.count("\n")) for r in docs.collect()) == [("1.kml", 2), ("2.kml", 4)]


def test_new_scenes_cost_a_call_a_bucket(spark, tmp_path):
    """Keys share the calls of the state function, and the states, of their buckets."""
    spark.range(6000).selectExpr("id % 3000 AS scene_id", "timestamp_seconds(id) AS datetime").coalesce(1).write.parquet(f"{tmp_path}/in")
    arrivals = spark.readStream.schema("scene_id long, datetime timestamp").parquet(f"{tmp_path}/in")
    query = intake.stream_new_scenes(arrivals, f"{tmp_path}/out", f"{tmp_path}/state", buckets=16)
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3000 and got.where("unix_seconds(datetime) <> scene_id").count() == 0
    assert sum(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 16


def test_new_scenes_with_keys_a_microsecond_apart(spark, tmp_path):
    spark.range(6).selectExpr("timestamp_micros(id % 3) AS scene_id", "timestamp_seconds(id) AS datetime").coalesce(1).write.parquet(f"{tmp_path}/in")
    arrivals = spark.readStream.schema("scene_id timestamp, datetime timestamp").parquet(f"{tmp_path}/in")
    intake.stream_new_scenes(arrivals, f"{tmp_path}/out", f"{tmp_path}/state", buckets=1).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_matrices_of_a_training_step_do_not_grow_with_the_partitions(spark):
    words = [f"{a}{b}{c}" for a in ("idi", "mor", "cat", "dog") for b in ("ot", "on", "ter", "gy") for c in "abcdefgh"]
    p = np.array([1.0 if w.startswith(("idiot", "moron")) else 0.0 for w in words])
    table = spark.createDataFrame(list(zip(words, p.tolist(), (1 - p).tolist())), "word string, p double, q double").repartition(60).localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("matrices", "training steps")
    toxicity.train_table(table, *toxicity.landmarks(words, p, 1 - p))
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("matrices") for s in tracker.getJobInfo(j).stageIds]
    assert 1 <= max(s.numTasks for s in stages if s) <= 24


def test_a_kernel_grows_with_shared_subsequences_not_with_the_marks():
    rng = random.Random(5)
    some = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    stems = [some(7) for _ in range(60)]
    words = [rng.choice(stems) + some(4) for _ in range(4096)]
    marks = words[::17]
    rows = [dict() for _ in words]
    for who, code, weight in toxicity.subsequences(words):
        for i, c, w in zip(who.tolist(), code.tolist(), weight.tolist()):
            rows[i][c] = rows[i].get(c, 0) + w
    square = toxicity.norms(words)
    tracemalloc.start()
    k = toxicity.kernel(words, marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(0, 4096, 41):
        for j, at in enumerate(range(0, 4096, 17)):
            plain = sum(w * rows[at].get(c, 0) for c, w in rows[i].items()) / (square[i] * square[at])
            assert abs(k[i, j] - plain) < 1e-5
    assert peak < 40e6  # bytes; the kernel itself has 4 and 8


def test_words_of_a_text_are_cut_into_subsequences_once(monkeypatch):
    words = ["gronk", "grunk", "table", "window"]
    machine = toxicity.folded(words, np.eye(4), np.array([1.0, 0.5, -1.0, -1.0, 0.1]))
    whole, calls = toxicity.subsequences, []
    monkeypatch.setattr(toxicity, "subsequences", lambda w: calls.append(1) or whole(w))
    toxicity.text_features(["gronk at the table", "", "a window"], machine)
    assert len(calls) == 1


def test_copies_of_a_labelled_text_do_not_meet_in_one_task(spark, monkeypatch):
    text = "the same gronk words again and again. "
    docs = spark.range(400).selectExpr("id AS doc_id", f"'{text}' AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    kept, made = toxicity.stable, []
    monkeypatch.setattr(toxicity, "stable", lambda df: made.append(kept(df)) or made[-1])
    toxicity.fit(docs, labels)
    sample = next(d for d in made if d.columns == ["text", "toxic"])
    assert sample.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100


def test_plans_of_a_round_of_components_stay_short(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    kept, joins = common.stable, []

    def watched(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return kept(df)

    monkeypatch.setattr(common, "stable", watched)
    got = [(r.node, r.root) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(got) == sorted(root.items())
    assert max(joins) <= 1
    joins.clear()
    common.components(spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "a long, b long")).collect()
    assert len(joins) == 1  # stars already, so no round


def _roots(spark, texts, keys, fps):
    """Least index of the texts each is linked to by ``similar_roots``, with band keys and fingerprints as given."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tk = {r.text: r.tk for r in docs.select("text", F.xxhash64("text").alias("tk")).collect()}
    n = [len(set(simhash.shingle_hashes(t, 5).tolist())) for t in texts]
    nodes = spark.createDataFrame([(tk[t], f, m, k) for t, f, m, k in zip(texts, fps, n, keys)], "tk long, fp long, n long, keys array<long>")
    root = {r.node: r.root for r in simhash.similar_roots(docs, nodes, 5, 4, 0.8).collect()}
    own = [root.get(tk[t], tk[t]) for t in texts]
    return [own.index(x) for x in own]


def _plain_roots(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


@pytest.mark.parametrize("side", [1000, 3])
def test_a_bucket_of_many_unlike_texts_loses_no_link(spark, monkeypatch, side):
    """All texts share one bucket and a passage; like ones stand far apart in the order of lengths."""
    monkeypatch.setattr(simhash, "SIDE", side, raising=False)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for g in range(40):
        own = " ".join(f"g{g}w{i}" for i in range(60 + rng.randrange(8)))
        texts += [f"{passage} {own}" + "".join(f" e{rng.randrange(10**6)}" for _ in range(extra)) for extra in ((0, 9, 18, 27) if g % 4 == 0 else (5,))]
    rng.shuffle(texts)
    fps = [rng.getrandbits(63) for _ in texts]
    want = _plain_roots(texts)
    assert len(set(want)) < len(texts)
    assert _roots(spark, texts, [[7]] * len(texts), fps) == want


def test_equal_fingerprints_are_compared_with_more_than_the_first(spark):
    unlike = [" ".join(f"u{k}w{i}" for i in range(30)) for k in range(4)]
    words = [f"a{i}" for i in range(30)]
    like = [" ".join(words), " ".join([*words, "z"])]
    texts = [*unlike, *like]
    assert _roots(spark, texts, [[k] for k in range(6)], [9] * 6) == [0, 1, 2, 3, 4, 4]


def test_a_family_of_texts_makes_few_pairs(spark):
    """Texts a few words from one base, most of them not alike: pairs are formed of about those that are."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(150):
        words = list(base)
        for i, at in enumerate(rng.sample(range(5, 145, 10), 3)):
            words[at + rng.randrange(10)] = f"t{k}e{i}" if k % 5 else f"e{at}"
        texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tk = {r.text: r.tk for r in docs.select("text", F.xxhash64("text").alias("tk")).collect()}
    rows = spark.createDataFrame([(k, k) for k in tk.values()], "node long, root long")
    got = {(r.a, r.b) for r in simhash.prefix_pairs(docs, rows, 5, 0.8).collect()}
    sets = {tk[t]: set(simhash.shingle_hashes(t, 5).tolist()) for t in texts}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert alike and alike <= got
    assert len(got - near) <= len(texts)  # of 11 000 pairs


def test_shuffles_behind_a_checkpoint_are_freed(spark, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, before = [], spark.conf.get(key)
    frame = type(spark.range(0))
    kept = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: seen.append(spark.conf.get(key)) or kept(self, *a, **k))
    d = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert stable(d).count() == 10
    table, remove = common.stored(d)
    assert table.count() == 10 and d.count() == 10 and len(d.collect()) == 10
    remove()
    assert seen == ["true"] and spark.conf.get(key) == before


def test_rows_of_a_source_are_kept_in_one_file(spark):
    """Every round of the dual and of the threshold would else write a file for each shuffle partition."""
    histogram = spark.createDataFrame([(k, s, n) for k in range(30) for s, n in ((1, 50), (10, 20), (500, 3))], "no int, size long, n long")
    targets = spark.createDataFrame([(k, "s", 1750, 700.0) for k in range(30)], "no int, source string, source_size long, target double")
    got = mixing.balance(histogram, targets)
    assert got.rdd.getNumPartitions() == 1 and got.count() == 30
