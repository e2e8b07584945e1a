import numpy as np

from tidemark.llm import contamination as con


def test_short_items_in_long_documents_are_all_found():
    rng = np.random.Generator(np.random.PCG64(9))
    word = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    items = [" ".join(word(int(n))) for n in rng.integers(5, 14, 300)]
    texts, want = [], set()
    for i, item in enumerate(items):
        body = word(600)
        at = int(rng.integers(0, 600))
        texts.append(" ".join(body[:at] + item.split() + body[at:] + item.split()))
        want.add((i, i))
    index = con.ItemIndex(list(range(len(items))), items)
    import pyarrow as pa

    sh, at = con._shingles(pa.array([*texts, None, ""]))
    found = index.search(sh, at, 0.8)
    assert {(r, i) for r, i, _ in found} >= want
    sets = [set(sh[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert set(found) == {(r, i, n) for r, own in enumerate(sets) for i, s in enumerate(index.sets) if (n := len(own & set(s.tolist()))) >= 0.8 * len(s)}
    assert con.ItemIndex([1], ["a b c"]).search(*con._shingles(pa.array(["x", "A b c", "a b c d e f"])), 0.8) == [(1, 0, 1)]
