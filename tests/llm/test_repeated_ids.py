"""Near-dedup of rows that share a doc_id."""

from veridiff.llm import near_dedup


def test_one_doc_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " tail"), (3, c), (3, None), (4, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(repr, map(tuple, near_dedup.deduplicate(docs).collect())))
    assert kept == sorted(map(repr, [(1, a), (1, b), (3, c), (3, None), (None, a)]))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(docs).collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 1, False)]


def test_contested_buckets_in_parts(spark, monkeypatch):
    """Buckets that many components share, cut into parts of four members, against all pairs."""
    import random

    from veridiff.llm import near_dedup

    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 6, 8])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "PART", 4)
    got = {r.doc_id: r.component_id for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    want = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert got == want and len(set(want.values())) > 1
