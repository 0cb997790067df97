import random

from clausewright.llm.components import connected_components
from clausewright.llm.neardup import _WORD, NearDupRule, near_duplicates

RULE = NearDupRule(shingle=3, threshold=0.6, min_words=10, rows=3, bands=64, star_bands=16)


def brute(rows, rule):
    sets = {}
    for i, h, t in rows:
        w = _WORD.findall((t or "").lower())
        if i is None or len(w) < rule.min_words:
            continue
        w = _WORD.findall((h or "").lower()) + w
        sets[i] = {tuple(w[k : k + rule.shingle]) for k in range(max(1, len(w) - rule.shingle + 1))}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= rule.threshold * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, find(i)) for i in sets}


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            n += 1
            rows.append((n, rng.choice([None, "head one", ""]), rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(900, "H", rows[3][2]), (901, None, None), (902, None, ""), (None, None, rows[3][2]), rows[5]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id long, heading string, text string, label string")
    got = {(r.chunk_id, r.group) for r in near_duplicates(df, "chunk_id", "text", "heading", RULE).collect()}
    assert got == brute(dict((r[0], r) for r in rows if r[0] is not None).values(), RULE)


def test_a_third_of_all_rows_in_one_family(spark):
    """Many distinct near copies share every bucket; they become one group."""
    base = [f"t{i}" for i in range(200)]
    rows = [(i, None, " ".join([*base[:100], f"edit{i}", *base[100:]])) for i in range(300)]
    rows += [(1000 + i, None, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "chunk_id long, heading string, text string")
    got = {r.chunk_id: r.group for r in near_duplicates(df, "chunk_id", "text", "heading", RULE).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))


def test_empty(spark):
    df = spark.createDataFrame([], "chunk_id long, heading string, text string")
    assert near_duplicates(df, "chunk_id", "text", "heading", RULE).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 50), (50, 201)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    got = {r.u: r.component for r in out}
    assert len(out) == len(got) and all(got[i] == 0 for i in range(41))
    assert got[101] == got[100] == 100 and got[200] == got[201] == got[50] == 50
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_two_large_families_that_meet_in_every_bucket(spark):
    """Families with half of their text in common share buckets; only a bridge links them."""
    common = [f"c{i}" for i in range(100)]

    def member(family, i):
        own = [f"{family}{k}" for k in range(60)]
        own[i % 60] = f"edit{family}{i}"
        return " ".join(common + own)

    rows = [(i, None, member("a", i)) for i in range(150)] + [(1000 + i, None, member("b", i)) for i in range(150)]
    df = spark.createDataFrame(rows, "chunk_id long, heading string, text string")
    got = {(r.chunk_id, r.group) for r in near_duplicates(df, "chunk_id", "text", "heading", RULE).collect()}
    assert got == brute(rows, RULE) and len({g for _, g in got}) == 2
    bridge = (5000, None, " ".join(common + [f"a{k}" for k in range(30)] + [f"b{k}" for k in range(30, 60)]))
    df = spark.createDataFrame([*rows, bridge], "chunk_id long, heading string, text string")
    got = {(r.chunk_id, r.group) for r in near_duplicates(df, "chunk_id", "text", "heading", RULE).collect()}
    assert got == brute([*rows, bridge], RULE) and len({g for _, g in got}) == 1


def test_no_bucket_is_held_in_one_task(spark):
    import inspect

    from clausewright.llm import neardup

    assert "Window" not in inspect.getsource(neardup)
