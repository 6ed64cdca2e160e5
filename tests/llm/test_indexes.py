"""Centroid clustering, spelling variants and keyed ids against brute force, with edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import DOCS, LONG
from termweave.llm import centroids, fm_index, keyed_ids, perfect_hash, spelling, word_ids
from termweave.llm.queries import BYTE_TOKENIZER, tokenizer_path
from termweave.llm.tables import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lloyd(rows, k, rounds, seed=2):
    """(id, cluster, distance) by full distance matrices; the final centroids."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    v = np.array([r[1] for r in rows])
    c = v[order[:k]].copy()
    for last in [False] * rounds + [True]:
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if not last:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = v[a == j].sum(axis=0) // (a == j).sum()
    return [(r[0], int(j), int(d[i, j])) for i, (r, j) in enumerate(zip(rows, a))], c


VECTORS = "vec_id long, embedding array<float>, label int, v string, dots string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "y", "z") for i, e in rows], VECTORS).repartition(3)


def test_clusters_equal_full_matrices(spark):
    dice = random.Random(5)
    rows = [(i, [dice.gauss(i % 3, 1) for _ in range(4)]) for i in range(120)]
    rows += [(500 + i, [0.25, 0.25, -0.5, 1.0]) for i in range(60)] + [(7, rows[7][1]), (None, [0.0] * 4)]
    kept = [(i, np.floor(256 * np.float32(e).astype(float)).astype(int).tolist()) for i, e in rows]
    bad = [(900, [1.0] * 3), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, None), (904, [float("-inf")] * 4), (905, [])]
    got = centroids.clusters(vectors(spark, rows + bad), k=5, rounds=3, dimension=4).collect()
    want, c = lloyd(kept, 5, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    inertia = collections.Counter()
    for _, j, d in want:
        inertia[j] += d
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) for r in got)
    assert {r.cluster: r.centroid_sha256 for r in got} == {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in inertia}


def test_dots_follow_the_centroids(spark):
    """The persisted products are those of the final centroids."""
    rows = [(i, [float((i * k) % 7 - 3) / 8 for k in range(1, 5)]) for i in range(80)]
    state, final = centroids.cluster_vectors(vectors(spark, rows), k=6, rounds=2, dimension=4)
    for r in state.collect():
        assert r.dots == (final @ np.array(r.v)).tolist()


def test_few_and_no_vectors(spark):
    got = centroids.clusters(vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), k=40, dimension=2).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (2, 0)] and len({r.cluster for r in got}) == 2
    same = centroids.clusters(vectors(spark, [(i, [1.0, 1.0]) for i in range(9)]), k=3, dimension=2).collect()
    assert {(r.cluster, r.distance) for r in same} == {(0, 0)}
    none = centroids.clusters(vectors(spark, [(1, [1.0])]), dimension=2)
    assert none.collect() == [] and len(none.columns) == 6
    with pytest.raises(Exception, match="after scaling"):
        centroids.clusters(vectors(spark, [(1, [1e30, 0.0])]), dimension=2).collect()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_search_schemes_find_each_half():
    dice = random.Random(1)
    for trial in range(150):
        letters, least = "abé"[:1 + trial % 3], 1 if trial % 2 else 6
        words = list({"".join(dice.choice(letters) for _ in range(dice.randint(least, 10))) for _ in range(40)})
        index, queries = fm_index.WordIndex(words), [*words, "zzzzzz"]
        found = {}
        for side in (fm_index.LEFT, fm_index.RIGHT):
            found[side] = {(queries[q], index.words[w]) for q, w in zip(*index.near(queries, side))}
        halves = {(a, b): len(a) // 2 for a in queries for b in words if one_edit(a, b)}
        assert found[fm_index.LEFT] == {(a, b) for (a, b), h in halves.items() if a[:h] == b[:h]}
        assert found[fm_index.RIGHT] == {(a, b) for (a, b), h in halves.items() if b.endswith(a[h:])}
        assert found[0] | found[1] == set(halves)


def test_suffix_array_is_sorted():
    codes = np.array([0, 1, 1, 1, 0, 2, 1, 0, 1, 0])
    order = fm_index.suffix_array(codes)
    assert order.tolist() == sorted(range(10), key=lambda i: codes[i:].tolist())


def variants(rows, least_count=5, noise=199):
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    words = {w: n for w, n in count.items() if n >= least_count}
    near = {w: [u for u in words if one_edit(w, u)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def text_rows():
    dice = random.Random(3)
    base = ["abcdef", "abcdefg", "überaus", "Straßen", "CAMELS", "camels", "camals", "camalsx", "élément", "ÉLÉMENT", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    out = []
    for d in range(60):
        words = [dice.choice(base[:1 + int(13 * dice.random() ** 2)]) for _ in range(60)]
        out.append((d, " ".join(words) + ", " + "-".join(words[:9]) + "'" + " x" * 3))
    return [*out, *out[:3], (None, "abcdef abcdeg " * 6), (61, None), (62, ""), (63, "x" * 9000 + " " + ("x" * 9000 + " ") * 5), (64, "12 34")]


def test_variants_equal_brute_force(spark):
    rows = text_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "k", "s", "r", "k") for d, t in rows], DOCS).repartition(3)
    for noise in (7, 199):
        got = spelling.variants(docs, noise=noise).collect()
        assert {tuple(r) for r in got} == {(w, f, r, n, k, c) for w, f, r, n, k, c in variants(rows, noise=noise)}
        assert len({r.word for r in got}) == len(got)


def test_crowded_halves_are_cut(spark):
    """Words that share a half are dealt in parts and still meet all others; chains of forms end."""
    words = [("commonalpha", 100_000), ("commonalph", 10_000), ("commonalp", 900), ("ommonalp", 50)]
    words += [(f"common{a}{b}{c}", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    frame = spark.createDataFrame(words, "word string, n long").repartition(4)
    got = spelling.near_words(frame, block=64, part=16).collect()
    assert {(r.word, r.near) for r in got} == {(a, b) for a, _ in words for b, _ in words if one_edit(a, b)}
    roots = {r.word: r.root for r in spelling.with_roots(spelling.forms(frame, block=64, part=16)).collect()}
    assert roots["ommonalp"] == roots["commonalp"] == roots["commonalpha"] == "commonalpha"


def test_no_words(spark, none):
    got = spelling.variants(none)
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    dice = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 500, 20_000):
        keys = dice.integers(0, 2**64, (2, n), dtype=np.uint64)
        made = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(*keys).to_bytes())
        slots = made.slots(*keys)
        assert sorted(slots.tolist()) == list(range(n))
        held = np.empty(n, np.uint32)
        held[slots] = perfect_hash.fingerprints(*keys)
        other = dice.integers(0, 2**64, (2, 5000), dtype=np.uint64)
        at = made.slots(*other)
        hit = at != perfect_hash.NONE
        assert not (held[at[hit]] == perfect_hash.fingerprints(*other)[hit]).any()
    with pytest.raises(ValueError, match="distinct"):
        perfect_hash.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_word_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(word_ids, "WORDS", 40)
    ids = word_ids.WordIds(tokenizer_path(BYTE_TOKENIZER))
    odd = ["", " ", "  a  b ", " a", "a\n b", "x<|endoftext|> y", "don't we'll 'tis '' 's", "\x1c a \x1d", "é—…  ¿qué?", "日本語 テキスト 123 ４５ ²",
           "\x01 a", "a. . .b ...", "1,000.50% (x)", "á b́. ", "end.\nNext one\n\nthree", "x" * 300 + " " + "-" * 100, LONG]
    dice = random.Random(3)
    odd += ["".join(dice.choice(" \n.,'sté1 a—²́\x85\x1c日") for _ in range(dice.randint(0, 25))) for _ in range(2000)]
    for text in odd:
        assert ids.ids(text) == ids.whole(text), repr(text)
    assert len(ids.young) <= 40 + len(set(LONG.split()))


def ids_of(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 2], "<u4").tobytes()


def test_ids_come_back_by_key(spark, docs):
    folder = new_path(spark, "ids")
    keyed_ids.write_archive(docs, tokenizer_path(BYTE_TOKENIZER), folder)
    got = sorted(keyed_ids.read_ids(spark, folder, keyed_ids.all_keys(spark, folder)).collect(), key=lambda r: r.start)
    rows = docs.select("doc_id", "text").collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == sorted(((r.doc_id, ids_of(r.text)) for r in rows), key=repr)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert {(r.doc_id, r.copy) for r in got} >= {(5, 0), (5, 1), (None, 0)} and len({(r.doc_id, r.copy) for r in got}) == len(got)
    asked = spark.createDataFrame([(5, 1), (5, 2), (99, 0), (4, 0), (None, 0), (None, 1)], "doc_id long, copy long")
    some = {(r.doc_id, r.copy): bytes(r.ids) for r in keyed_ids.read_ids(spark, folder, asked).collect()}
    assert set(some) == {(5, 1), (4, 0), (None, 0)} and some[5, 1] == some[4, 0] == ids_of(LONG)


def test_copies_count_on_across_shards(spark):
    """One doc_id fills several shards; its copies are numbered through."""
    rows = [(3, f"text {i}") for i in range(400)] + [(i, "other") for i in range(8)] + [(None, "none")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = new_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed_ids.write_archive(docs, tokenizer_path(BYTE_TOKENIZER), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = keyed_ids.all_keys(spark, folder)
    assert spark.read.parquet(f"{folder}/keys").where("doc_id = 3").select("part").distinct().count() > 1
    copies = collections.defaultdict(list)
    for r in keys.collect():
        copies[r.doc_id].append(r.copy)
    assert sorted(copies[3]) == list(range(401)) and sorted(copies[None]) == list(range(50))
    got = keyed_ids.read_ids(spark, folder, keys)
    assert sorted(bytes(r.ids) for r in got.collect()) == sorted(ids_of(t) for _, t in rows)


def test_empty_archive(spark, none):
    got = keyed_ids.round_trip(none, tokenizer_path(BYTE_TOKENIZER), new_path(spark, "ids"))
    assert got.collect() == []


def test_lost_writers_leave_no_trace(spark, docs):
    """Files that no committed row names are not part of the archive."""
    folder = new_path(spark, "ids")
    with keyed_ids._created(folder, "ids-of-a-lost-task") as out:
        out.write(b"torn")
    got = keyed_ids.round_trip(docs, tokenizer_path(BYTE_TOKENIZER), folder)
    assert got.count() == docs.count()
