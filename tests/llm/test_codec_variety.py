"""Merge-dropout is drawn for each occurrence of a word."""

from veridiff.llm import sentencepiece_codec


def test_each_occurrence_is_cut_by_itself():
    path = sentencepiece_codec.default_model()
    codec, n = sentencepiece_codec.Codec(path, 0.1, seed=1), 4000
    text = " ".join(["understanding"] * n)
    ids = codec.encode(text, 9)
    assert codec.decode(ids) == text
    want = [x for k, c in enumerate([" understanding"] * n) for x in codec.encode_chunk(c, variant(codec, 9, k))]
    assert ids.tolist() == want
    cuts = {tuple(codec.encode_chunk(" understanding", variant(codec, 9, k))) for k in range(n)}
    assert len(cuts) > 8
    # a chunk of one merge is cut in every document's share of about a tenth, in none of them always or never
    shares = [sum(len(codec.encode("of", doc)) > 1 for doc in range(s, s + 1000)) for s in (0, 1000)]
    assert all(50 < x < 300 for x in shares)


def variant(codec, doc, place):
    import numpy as np
    import xxhash

    from veridiff.llm import common as C

    key = np.array([xxhash.xxh64_intdigest(f"{codec.seed}:{doc}")], C.U64)
    return int(C.mix(np.array([place], C.U64) * C.U64(0x9E3779B97F4A7C15) ^ key)[0])
