import random
import re

import numpy as np
import pytest

from cohortloom.llm import set_join
from cohortloom.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows):
    """(doc_id, n, component) by all pairs and a plain search."""
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((row[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def noisy(seed):
    """Families of near copies around the threshold, a passage shared by many, short and repeated texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    passage = " ".join(word() for _ in range(40))
    rows = []
    for family in range(10):
        base = [word() for _ in range(rnd.choice([6, 12, 40, 120]))]
        for _ in range(rnd.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy = copy[: int(len(copy) * rnd.uniform(0.7, 1))]
            text = " ".join(copy)
            rows.append((len(rows), text if rnd.random() < 0.8 else text.upper().replace(" ", "\n\t"), "x", "y"))
    for _ in range(25):
        own = " ".join(word() for _ in range(rnd.choice([3, 8, 12, 60])))
        rows.append((len(rows), f"{own} {passage}", "x", "y"))
    rnd.shuffle(rows)
    return rows


def answer(docs):
    return sorted((tuple(r)[:3] for r in set_join.link_components(docs).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_families_against_all_pairs(spark, seed):
    rows = noisy(seed)
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_without_broadcasts_and_with_other_orders(spark, monkeypatch):
    from cohortloom.llm import common

    rows = noisy(9)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(set_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(set_join, "_LOCAL", 2)
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    monkeypatch.setattr(set_join, "HEAVY", 0)
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def linked_without_bound(pairs):
    """(cid, other) where some member that is not larger links with the query, by their whole sets."""
    return {(q, g) for q, query, g, group in pairs if any(len(x) <= len(query) and 7 * len(query & x) >= 3 * (len(query) + len(x)) for x in group)}


def matrix_rows(pairs):
    """What ``_qualifying`` is given: the matches of each query's long prefix in its group; shingles order as numbers."""
    long = lambda x: sorted(x)[: len(x) - (3 * len(x) + 3) // 4 + 1]
    short = lambda x: sorted(x)[: len(x) - (6 * len(x) + 6) // 7 + 1]
    for q, query, g, group in pairs:
        for at, token in enumerate(long(query)):
            held = [(len(x), short(x).index(token) + 1) for x in group if token in short(x)]
            n = len(query)
            if held and 4 * max(held)[0] >= 3 * n and min(held)[0] <= n:
                yield q, g, token, n, at + 1, min(held)[0], max(held)[0], min(place for _, place in held)


def test_no_group_with_a_link_is_closed(spark):
    rnd = random.Random(5)
    # the first member lies in the query as a whole; the second one's first match says nothing about it
    pairs = [(0, {0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11}, 0, [{2, 3, 4, 5, 6, 8, 9, 10, 11}, {1, 2, *range(4, 12)}])]
    # a query far larger than one member and as large as the other
    shared = set(range(100, 157))
    pairs += [(1, shared | set(range(15)), 1, [shared, {14, *range(1000, 1071)}])]
    for i in range(len(pairs), 4000):
        query = set(rnd.sample(range(60), rnd.randint(3, 40)))
        group = []
        for _ in range(rnd.randint(1, 4)):
            member = {x for x in query if rnd.random() < 0.95} | set(rnd.sample(range(60), rnd.randint(0, 8)))
            group.append(member or {1})
        pairs.append((i, query, i, group))
    met = spark.createDataFrame(list(matrix_rows(pairs)), "cid long, other long, token long, n long, at long, low long, high long, first long")
    opened = {tuple(r) for r in set_join._qualifying(met).collect()}
    want = linked_without_bound(pairs)
    assert {(0, 0), (1, 1)} <= want and len(want) > 1000
    assert want <= opened and len(opened) < len(pairs)


def family(n, words, changes, seed):
    """``n`` near copies of one text with up to ``changes`` of its words changed."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, changes)):
            copy[rnd.randrange(words)] = f"c{rnd.randint(0, 10**6)}"
        out.append((i, " ".join(copy), "x", "y"))
    return out


@pytest.mark.parametrize("words,changes", [(80, 3), (80, 6), (15, 2)])
def test_large_family_against_all_pairs(spark, words, changes):
    rows = family(250, words, changes, words + changes) + [(1000 + i, t, a, b) for i, t, a, b in noisy(7)]
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_work_on_a_family_grows_in_proportion(spark, monkeypatch):
    """Rows of the written steps for four times as many near copies."""

    def steps(n):
        sizes = {}

        def counting(df, name="stage"):
            out = plain(df, name)
            sizes[name] = max(sizes.get(name, 0), out.count())
            return out

        monkeypatch.setattr(set_join, "materialize", counting)
        rows = family(n, 80, 3, 1) + [(10_000 + i, " ".join(f"r{i}x{k}" for k in range(60)), "x", "y") for i in range(600)]
        set_join.link_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).count()
        return sizes

    plain = set_join.materialize
    small, large = steps(150), steps(600)
    for name in ("join-met", "join-asking", "join-pairs"):
        assert large[name] <= 7 * max(small[name], 200), (name, small, large)


def test_odd_rows(spark, odd_docs):
    rows = [*odd_docs, (None, "null id text of six words", "x", "y"), (None, None, "x", "y")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", n_shingles string, cid int")
    assert answer(docs) == brute(rows)
    assert answer(docs.where("false")) == []


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from cohortloom.llm import shingles

    text = " ".join(f"Word{i}é\n" for i in range(5000)) + " " + "x" * 500
    whole = shingle_set(text)
    monkeypatch.setattr(shingles, "_PIECE", 97)
    assert (shingle_set(text) == whole).all() and len(whole) == 4997


def test_parities_bound_the_difference_and_part_long_sets():
    rnd = np.random.default_rng(5)
    for n, m in [(3, 3), (200, 240), (900, 1100), (1000, 1000), (2100, 1700)]:
        common = min(n, m) // 2
        pool = rnd.integers(0, 1 << 63, n + m - common, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, n + m - common, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
        apart = set_join._differing(*(np.packbits(set_join._parity(x)) for x in (a, b)))
        assert apart <= len(np.setxor1d(a, b))
        assert apart == set_join._differing(*(np.packbits(set_join._parity(x)) for x in (b, a)))
        if n >= 200:  # half of each set differs, a link allows a seventh of both
            assert 7 * apart > n + m


def test_whole_sets_are_moved_for_pairs_that_parities_leave(spark, monkeypatch):
    """Texts of 1,000 words that share 70 % are candidates, but no set of theirs is compared."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    base = [word() for _ in range(1000)]
    rows = [(i, " ".join(base[:700] + [word() for _ in range(300)]), "x", "y") for i in range(6)]
    rows += [(10 + i, " ".join(base[:990] + [word() for _ in range(10)]), "x", "y") for i in range(2)]
    compared = []
    plain = set_join._sets
    monkeypatch.setattr(set_join, "_sets", lambda *x: (compared.append(x[-1].count()), plain(*x))[1])
    assert answer(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert sum(compared) <= 4


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_over_the_shingles_do_not_change_links(spark, monkeypatch, passes):
    rows = noisy(4)
    monkeypatch.setattr(set_join, "_PASSES", passes)
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(2)) == brute(rows)
