"""The training-data operators on small tables: brute force, round trips and the defined edge cases."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veridiff.llm import chat_format, decontaminate, html_extraction, language_id, language_model, metric_search, near_dedup, sentencepiece_codec, substring_dedup, token_files
from veridiff.llm.common import shared_path
from veridiff.llm.queries import ORACLE_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string"


def words(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, 150, 400) for _ in range(6)]
    out = {0: base[0], 1: base[0], 2: base[0] + " tail end", 3: base[1], 4: base[2] + " " + base[1], 5: None, 6: "", 7: "one two", 8: "ONE two", 9: " \t\n", 10: "é 日本 😀 x", 11: base[3]}
    for k in range(12, 40):
        w = base[k % 6].split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        out[k] = " ".join(w)
    out[40] = words(rng, 4000, 5000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "xx" if k % 2 else "yy", "s", len(t or ""), "clash") for k, t in texts.items()]
    return spark.createDataFrame([*rows, rows[3], (None, texts[0], None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(spark, docs, texts, none):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.components(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])
    kept = [r.doc_id for r in near_dedup.deduplicate(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({k for k in texts if label[k] == k}) and None in kept
    assert near_dedup.components(none).count() == 0


def test_substring_dedup(docs, texts, none):
    window = 20
    first = {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    for r in substring_dedup.removed_words(docs, window, with_text=True).collect():
        w = ((texts[0] if r.doc_id is None else texts[r.doc_id]) or "").encode().split()
        gone = set()
        if r.doc_id is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < r.doc_id:
                    gone |= set(range(i, i + window))
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        if gone:
            assert r.text == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert substring_dedup.substring_dedup(none).count() == 0


def test_decontaminate(spark, docs, texts, none):
    item = " ".join(texts[3].split()[20:60])
    short, four = " ".join(texts[4].split()[50:52]), " ".join(texts[11].split()[-4:]).upper()
    bench = [(1, item), (2, "unseen words of an item that leaks nowhere at all"), (3, None), (4, ""), (5, "one two"), (6, short), (7, four), (8, short), (8, item), (8, item)]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.n_item_shingles) for r in decontaminate.leaks(docs, bench).collect()}
    want = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        d = shingles(t) | {tuple(w[i : i + n]) for n in (2, 4) for i in range(len(w) - n + 1)}
        for i, xs in ((1, [item]), (5, ["one two"]), (6, [short]), (7, [four]), (8, [short, item])):
            q = set().union(*map(shingles, xs))
            if 100 * len(q & d) >= 75 * len(q):
                want[k, i] = (len(q & d), len(q))
    assert got == want and {i for _, i in want} == {1, 5, 6, 7, 8}
    con = duckdb.connect()
    for name, rows in (("documents", [(k, t) for k, t in texts.items()]), ("benchmark", [tuple(r) for r in bench.collect()])):
        con.execute(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert {(r[0], r[1]): (r[2], r[3]) for r in con.execute(f"SELECT doc_id, item_id, shared, n_item_shingles FROM ({ORACLE_SQL['op5_decontaminate']})").fetchall()} == want
    assert decontaminate.leaks(docs, bench, part_shingles=10).count() == len(want)
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_metric_search(spark):
    rng = np.random.default_rng(3)
    x = [[float(v) for v in r] for r in rng.normal(size=(300, 8))]
    x[7], x[8], x[9] = None, [float("nan")] + x[8][1:], [None] + x[9][1:]
    for k in range(50, 90):
        x[k] = x[50]
    x[11] = x[11][:4]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {}
    for r in metric_search.top_k(df, F.col("vec_id") % 5 == 0, 20, most=64, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    ok = {k: np.floor(64 * np.array(v)).astype(int) for k, v in enumerate(x) if v is not None and None not in v and np.isfinite(v).all()}
    for q in [k for k in ok if k % 5 == 0]:
        best = sorted((-int(v @ ok[q]), k) for k, v in ok.items() if k != q and len(v) == len(ok[q]))[:20]
        assert sorted(got.get(q, [])) == [(i + 1, -s, k) for i, (s, k) in enumerate(best)]
    assert metric_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_language_id(spark, none):
    rng = random.Random(1)
    rows = []
    for k in range(200):
        syl = ("tion", "the", "ing") if k % 2 else ("eau", "aux", "les")
        rows.append((k, " ".join("".join(rng.choice(syl) for _ in range(3)) for _ in range(30)), "en" if k % 2 else "fr"))
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34!", None)], "doc_id long, text string, lang string")
    held = language_id.held_out("doc_id", 4, 2)
    model = language_id.train(df.where(~held))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert language_id.train(none)[0] == []


def test_language_model(docs, texts, none):
    rows = [(k, t) for k, t in texts.items()] + [(3, texts[3]), (None, texts[0])]
    count = {}
    for k, t in rows:
        if not language_model.is_held_out(k):
            for w in [*(t or "").encode().lower().split(), None]:
                count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [*((texts[0] if r.doc_id is None else texts[r.doc_id]) or "").encode().lower().split(), None]
        base = sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (len(count) + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score <= 0
    assert language_model.score(none).count() == 0


def test_language_model_weights(spark):
    """The automaton against its formula, for two and three words."""
    train = [(0, "a b a c"), (2, "b a"), (3, "a c c a b"), (4, None)]
    probes = [(100 + i, t) for i, t in enumerate(["a", "a b a", "zz a c", "c c", ""])]
    df = spark.createDataFrame(train + probes, "doc_id long, text string")
    seqs = [[*(t or "").split(), None] for _, t in train]
    count = {}
    for q in seqs:
        for n in (1, 2, 3):
            for i in range(len(q) - n + 1):
                count[tuple(q[i : i + n])] = count.get(tuple(q[i : i + n]), 0) + 1
    total, distinct = sum(map(len, seqs)), len({w for q in seqs for w in q})

    def p(h, w):
        if not h:
            return (count.get((w,), 0) + 0.5) / (total + 0.5 * (distinct + 1))
        return (count.get((*h, w), 0) + language_model.K * p(h[1:], w)) / (count.get(h, 0) + language_model.K)

    for order in (2, 3):
        got = {r.doc_id: r.score for r in language_model.score(df, order, held_out=lambda k: k >= 100).collect()}
        for k, t in probes:
            q = [*t.split(), None]
            assert got[k] == pytest.approx(sum(np.log10(p(tuple(q[max(0, i - order + 1) : i]), w)) for i, w in enumerate(q)))


def test_token_files(spark, docs, texts, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    for mode in ("bit", "byte"):
        manifest = token_files.write(docs, shared_path(spark, "t"), token_files.default_tokenizer(), mode, file_tokens=2000)
        got = sorted(token_files.read_digests(manifest).collect(), key=lambda r: r.start)
        rows = sorted([(k, t) for k, t in [*texts.items(), (3, texts[3])]], key=lambda x: x[0])
        start = 0
        for r, (k, t) in zip(got, [(None, texts[0]), *rows], strict=True):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.read_digests(token_files.write(none, shared_path(spark, "t"), token_files.default_tokenizer())).count() == 0
    x = np.arange(70_000, dtype=np.uint32) * 7
    assert all((token_files.from_planes(token_files.to_planes(x, m), len(x), m) == x).all() for m in ("bit", "byte"))


def test_sentencepiece(docs, texts):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    sp, plain = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert all(plain.encode(t).tolist() == sp.encode(t) for t in texts.values() if t)
    noisy = [sentencepiece_codec.Codec(path, 0.3, seed=s) for s in (1, 2)]
    for t in ["▁▁ x▁y", "a  b\n\n c ", *[t for t in texts.values() if t]]:
        a, b = (c.encode(t, 4) for c in noisy)
        assert all(c.decode(x) == t for c, x in zip(noisy, (a, b)))
    assert len(a) != len(b) or (a != b).any()
    chunks = sorted({w for t in texts.values() if t for w in (" " + t).split(" ")})
    chunks += ["▁é漢😀x", "\t", " 日本語", "🙂"]
    order, ids, sizes = noisy[0].encode_many(chunks, [1] * len(chunks))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [noisy[0].encode_chunk(chunks[k], 1) for k in order]
    # by place: equal words of one text take several variants, and the memory changes nothing
    assert len({tuple(noisy[0].encode(" ".join(["understanding"] * n), 9)[-6:].tolist()) for n in range(1, 40)}) > 2
    fresh = sentencepiece_codec.Codec(path, 0.3, seed=1)
    long = [t for t in texts.values() if t] + ["x" * 60 + " b", ""]
    assert all((x == fresh.encode(t, 4)).all() for x, t in zip(noisy[0].encode_all(long, [4] * len(long)), long))
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()
    assert all(r.decoded == (texts[0] if r.doc_id is None else texts[r.doc_id]) for r in got)


def test_html():
    page = (
        "<html><head><title>T</title><script>x='</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies, a long text about them.</div>"
        "<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\ntext.<p>In.<aside>Related</aside><div class=comments><p>A reader says this is quite long a comment.</p></div></article><footer>&copy; x</footer></body></html>"
    )
    assert html_extraction.extract(page) == "Title & more\nFirst bold text.\nIn."
    body = "<body><div id=sidebar><p>Links and other things here</p></div><div id=content><p>" + "Long text here. " * 9 + "</p><p>Short.</p><p>" + "More text there. " * 9 + "</p></div><form><p>Name</p></form></body>"
    assert html_extraction.extract(body).split("\n")[1] == "Short." and "Links" not in html_extraction.extract(body)
    assert html_extraction.extract(None) == html_extraction.extract("") == html_extraction.extract("<p> </p>") == ""


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "", None, "▁ plain  text\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(said)] + [(None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = sentencepiece_codec.default_model()
    turns = chat_format.format_turns(df, model)
    c = sentencepiece_codec.Codec(model)
    got = {(r.conv_id, r.turn): chat_format.read_turn(r.ids, r.mask, c) for r in turns.collect()}
    for conv, turn, role, text in rows:
        back = got[conv, turn]
        assert back[:2] == (role or "", text or "") and back[2] == ((text or "") if role == "assistant" else "")
    d = {r.conv_id: r for r in chat_format.read_digests(turns, model).collect()}
    assert d[1].n_turns == 5 and d[None].loss_chars == 0
    assert chat_format.read_digests(chat_format.format_turns(df.limit(0), model), model).count() == 0
