import random
import zlib

import fixtures
import numpy as np
from eoframe.llm import toxicity

INSULTS = ["idiot", "moron", "worthless", "scum"]


def corpus(n=600):
    rng = random.Random(9)
    words = ["".join(rng.choice("abdefghlnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(INSULTS)
        rows.append((100 + i, " ".join(text[:30]) + ". " + " ".join(text[30:]), "en", "s", 1))
        labels.append((100 + i, int(toxic)))
    return rows, labels, words


def test_held_out_and_gapped(spark):
    rows, labels, words = corpus()
    probe = ["you idxiot go", "m-o-r-o-n", "such s c u m here", "w.o.r.t.h.l.e.s.s", "IDIOT!"]
    clean = [" ".join(words[i : i + 20]) for i in range(0, 100, 20)]
    more = [(10_000 + i, t, "en", "s", 1) for i, t in enumerate(probe + clean)] + fixtures.ROWS[3:5]
    docs = fixtures.docs(spark, rows + more, extra=True)
    lab = spark.createDataFrame(labels + [(None, 1), (77_777, 1), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, lab).collect()}
    assert len(got) >= len(rows) + len(probe) + len(clean)
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    auc = np.mean([a > b for a, x in held if x for b, y in held if not y])
    assert auc > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    bad = [got[10_000 + i].score for i in range(len(probe))]
    good = [got[10_000 + len(probe) + i].score for i in range(len(clean))]
    assert min(bad) > max(good)


def test_kernel_of_near_words():
    k = toxicity.kernel(["idiot", "idxiot", "id.i.ot", "garden"], ["idiot"])[:, 0]
    # "i" occurs twice, so subsequences do, and likeness to itself is not quite 1
    assert abs(k[0] - 1) < 0.2 and k[2] == k[0] and 0.2 < k[1] < k[0] and k[3] < 0.05


def test_table_equals_kernel_machine():
    words = [f"{a}{b}" for a in ("idi", "mor", "cat", "dog") for b in ("ot", "on", "ter", "gy")]
    p = np.array([1.0 if w in ("idiot", "moron") else 0.0 for w in words])
    machine = toxicity.train_words(words, p, 1 - p)
    x = toxicity.text_features(words, machine)
    assert x[words.index("idiot"), 4] > 0 > x[words.index("catter"), 4]


def test_labelled_texts_without_words(spark):
    ids = [i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, toxic int")
    for texts in ([None, ""], ["...", "a ½½ b"]):
        docs = fixtures.docs(spark, [(i, texts[n % 2], "en", "s", 1) for n, i in enumerate(ids)])
        assert {r.score for r in toxicity.classify(docs, labels).collect()} == {0.5}


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(fixtures.docs(spark), none).collect()} == {0.0}
    assert toxicity.classify(fixtures.empty(spark), none).count() == 0
    d = fixtures.docs(spark, extra=True)
    assert toxicity.drop_toxic(d, d, none).count() == len(fixtures.ROWS)


def test_all_words_train(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 320)
    rows, labels, _ = corpus()
    # each seen once in a toxic text: a tie beyond the number of words that landmarks are chosen from
    ids = [i for i, y in labels if y and zlib.crc32(str(i).encode()) % 4 != 2]
    rare = [f"{a}{b}{c}{end}" for end in ("qqvk", "zzwyxk") for a in "abcdefgz" for b in "aeio" for c in "bcdfglm"]
    texts = {r[0]: r[1] for r in rows}
    for k, word in enumerate(rare):
        texts[ids[k % len(ids)]] += f" {word}"
    docs = fixtures.docs(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])
    seen = []
    real = toxicity.train_table
    monkeypatch.setattr(toxicity, "train_table", lambda words, *a: (seen.extend(r.word for r in words.collect()), real(words, *a))[1])
    machine, _ = toxicity.fit(docs, toxicity.training_labels(spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert set(rare) <= set(seen)
    assert len(seen) > 320
    # sums over tasks are those of one plain list
    words = [f"{a}{b}" for a in ("idi", "mor", "cat", "dog") for b in ("ot", "on", "ter", "gy")]
    p = np.array([1.0 if w in ("idiot", "moron") else 0.0 for w in words])
    table = spark.createDataFrame(list(zip(words, p.tolist(), (1 - p).tolist())), "word string, p double, q double").repartition(3)
    one, many = toxicity.train_words(words, p, 1 - p), real(table, *toxicity.landmarks(words, p, 1 - p))
    assert (one[0] == many[0]).all() and np.allclose(one[1], many[1], atol=1e-4)
