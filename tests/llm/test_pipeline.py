"""The pipeline's stages against plain versions of themselves, on a table with nulls, repeats, ties and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridiff.llm import decontaminate, language_id, near_dedup, sentencepiece_codec, substring_dedup

NAMES = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, leak_id long, cut_id string, cut_md5 string, cut_text string, digest string, named string"


def table():
    rng = random.Random(11)
    english = "the of and that with for this have from they which were their said would".split()
    german = "der die und das nicht mit sich auch wird eine haben werden sein durch wurde".split()
    text = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    item, passage = text(english, 20), text(german, 70)
    out = {k: text(english if k % 2 else german, 120) for k in range(1, 15)}
    out[15] = out[3]  # an exact copy
    out[16] = out[4] + " tail"  # a near copy
    out[17] = text(english, 40) + " " + item + " " + text(english, 40)  # a leak
    out[18], out[19] = text(german, 30) + " " + passage + " " + text(german, 30), text(german, 25) + " " + passage + " " + text(german, 35)  # a shared passage
    out[20], out[21], out[22] = None, "", "12 34"
    return out, item


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, item = table()
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en" if k % 2 else "de", "s", len(t or ""), 1, 2, "a", "b", "c", "d", "e") for k, t in texts.items()]
    spark.createDataFrame([*rows, rows[0]], NAMES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_against_plain_stages(spark, folder):
    texts, item = table()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out("doc_id", 4, 2)))
    pred, score = language_id.score_texts(list(texts.values()), *model)
    left = {k: t for (k, t), p, s in zip(texts.items(), pred, score) if p != "und" and s >= 0.5}
    assert set(left) == set(range(1, 20))
    sets = {k: shingles(t) for k, t in left.items()}
    label = {k: k for k in left}
    for _ in left:
        for a in left:
            for b in left:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    left = {k: t for k, t in left.items() if label[k] == k}
    assert not {15, 16} & set(left)
    cut = {}
    for k, t in left.items():
        w = t.split()
        gone = set()
        for i in range(len(w) - 49):
            if any(j < k and f" {' '.join(w[i : i + 50])} " in f" {' '.join(u.split())} " for j, u in left.items()):
                gone |= set(range(i, i + 50))
        cut[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    assert len(cut[19].split()) == 60
    kept = {k: t for k, t in cut.items() if t and 100 * len(shingles(t) & shingles(item)) < 75 * len(shingles(item))}
    assert 17 not in kept
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_model(), sentencepiece_codec.DROPOUT, sentencepiece_codec.SEED)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(kept)
    for k, ids in got.items():
        assert ids == codec.encode(kept[k], k).tolist() and codec.decode(ids) == kept[k]


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none, bench = docs.limit(0), spark.read.parquet(f"{folder}/benchmark.parquet")
    for stage in (language_id.keep_identified, near_dedup.deduplicate, substring_dedup.removed_repeats, lambda d: decontaminate.decontaminate(d, bench)):
        out = stage(none)
        assert out.columns == docs.columns and out.count() == 0
    some = docs.where(F.col("doc_id").isin(1, 3, 15, 17, 18, 19, 20))
    for stage, want in ((substring_dedup.removed_repeats, [1, 1, 3, 17, 18, 19, 20]), (lambda d: decontaminate.decontaminate(d, bench), [1, 1, 3, 15, 18, 19, 20])):
        out = stage(some)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == want
