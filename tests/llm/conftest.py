import random

import pytest

EXTRA = ["rep", "band", "root", "g", "kind", "part", "node", "k1", "batch", "row", "lid", "grade", "item_id", "message", "tie", "next"]


def words(rng, n):
    syl = ["th", "er", "on", "an", "re", "la", "que", "sch", "é", "ß", "日本"]
    return ["".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    base = [" ".join(words(rng, rng.randint(1, 150))) for _ in range(60)]
    passage = " ".join(words(rng, 30))
    out = list(base)
    for k in range(15):
        w = base[k].split()
        if len(w) > 40:
            near = list(w)
            near[rng.randrange(len(near))] = "changed"
            out += [" ".join(near), " ".join(near[: len(near) - 2])]
        out.append(base[k])
    out += [f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 9))}" for _ in range(8)]
    out += [None, "", " \n\t ", "one", "ONE", "two words", "x" * 400, "a b " * 300, "     ", " ".join(words(rng, 30_000)), "ab" * 40_000]
    rng.shuffle(out)
    rows = [(3 * k + 1, t) for k, t in enumerate(out)]
    rows += [rows[5], rows[5], (None, out[0]), (None, None), (None, passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, with other columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["z"] * len(EXTRA)) for i, t in corpus], schema).repartition(3)
