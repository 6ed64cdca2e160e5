"""The dealt operators against brute force, and on nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import compare
import numpy as np
import pytest
from conftest import PARA, rows
from pyspark.sql import functions as F

from termweave.llm import (decontamination, hidden_markov, language, lines, packing, personal, quality, queries, simhash,
                           urls, warc)
from termweave.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    ok, note = compare.check(spark, compare.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok and "TYPES" not in note, note


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in queries.QUERIES}


# --- 1 packing -----------------------------------------------------------------------

def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=256, open_windows=2).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc, text, *_ in {(r[0], r[1]) for r in rows()}:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        copies = sum(r[0] == doc for r in rows())
        found = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(len(r.ids) for r in found) == copies * len(ids)
        assert all(bytes(r.ids) == ids[4 * r.start:4 * (r.start + r.length)] and r.doc_tokens == len(ids) // 4 for r in found)
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(x[1] for x in p) < 256 for p in by_seq.values()) <= 4
    assert packing.pack(none, path).count() == 0
    whole = packing.sequences(packing.pack(docs.where("doc_id = 1"), path)).first()
    assert len(whole.ids) // 4 == sum(r.length for r in pieces[1])


@pytest.mark.parametrize("text", ["a\xa0b", "x\x1cy z", "don't I'LL", "<|endoftext|> a", "ΣΑΣ.", "é Ǻ,", "日本語、 한국어.", "\x01 a"])
def test_words_of_the_tokenizer(text):
    own = packing.WordTokenizer(queries.tokenizer_path())
    assert own.ids(text) == own.whole(text)


def test_word_store_on_a_whole_table(spark, monkeypatch):
    """The ids of every text are the tokenizer's, also when the store turns over many times."""
    monkeypatch.setattr(packing, "CACHED", 3000)
    own, turned = packing.WordTokenizer(queries.tokenizer_path()), 0
    for text in ["İ.", "sİ, ß.", *[r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]]:
        before = own.old
        assert own.ids(text) == own.whole(text)
        turned += own.old is not before
        assert len(own.known) <= 3000 + 2 * len(text.split())
    assert turned > 3


# --- 2 quality -----------------------------------------------------------------------

def brute_measures(text):
    text = text or ""
    words, shown = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    runs, covered = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(shown) - len(set(shown)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_measures(spark, docs, none):
    for table in (docs, sample(spark)):
        texts = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        got = quality.quality_filter(table).collect()
        assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {
            (d, *brute_measures(t)) for d, t in texts}
        assert not any(r.base_failed and r.kept for r in got) and any(r.kept for r in got)
    assert quality.quality_filter(none).count() == 0


def test_quantile_sketch(spark):
    rows_ = quality.measures(sample(spark))
    merged = quality.quantiles(quality.merge(quality.sketch(rows_, ["lang", "source"]), []), [], {"q": 0.5}).collect()
    exact = rows_.selectExpr("word_chars / greatest(n_words, 1) as m").approxQuantile("m", [0.5], 0)[0]
    assert next(r.q for r in merged if r.measure == "mean_word") == pytest.approx(exact, rel=0.021)


def test_limits_follow_the_spread_of_a_group(spark):
    """One document of 12 symbols in 100 words is far out in a source without symbols, and common in another."""
    def text(n, symbols, size=4):
        return " ".join(f"{i:0{size}d}" + "#" * (i < symbols) for i in range(n))

    plain = [text(100 + k, k % 2) for k in range(200)] + [text(100, 12), text(100, 0, 7)]
    mixed = [text(100 + k, k % 30, 4 + k % 5) for k in range(200)] + [text(100, 12), text(100, 0, 7)]
    table = spark.createDataFrame([(k, t, "en", s) for s, texts in (("plain", plain), ("mixed", mixed))
                                   for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {(r.source, r.doc_id): r for r in quality.quality_filter(table).collect()}
    assert "symbol_share" in got["plain", 200].outside and not got["plain", 200].kept and got["mixed", 200].kept
    assert got["plain", 201].outside == ["mean_word"] and got["mixed", 201].kept
    assert all(got["plain", k].kept for k in range(200))


# --- 3 near duplicates ---------------------------------------------------------------

def brute_print(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs, none):
    for table in (docs, sample(spark)):
        texts = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        prints = {t: brute_print(t) for _, t in texts}
        group = {p: {p} for p in prints.values()}
        for p in group:
            for q in list(group):
                if (p ^ q).bit_count() <= 4 and group[p] is not group[q]:
                    group[p] |= group[q]
                    for x in group[q]:
                        group[x] = group[p]
        want = collections.Counter()
        for d, t in texts:
            own = [e for e, u in texts if prints[u] in group[prints[t]] and e is not None]
            want[d, prints[t], min(own) if own else None] += 1
        got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(table).collect())
        assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_blocks_lose_no_link(spark):
    """One list longer than a block: a chain of prints that agree in three bytes."""
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 1 << 40, 3000) & 0x0F0F0F0F0F)
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    seen = {}
    for i in range(len(prints)):
        if i not in seen:
            front, seen[i] = [i], i
            while front:
                for j in np.flatnonzero(near[front.pop()]):
                    if int(j) not in seen:
                        seen[int(j)] = i
                        front.append(int(j))
    groups = collections.defaultdict(set)
    for i, p in enumerate(prints):
        groups[roots.get(int(p), int(p))].add(seen[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(seen.values()))


def test_keep_one(spark, docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 7, 8, 9, 10, 11, 12]
    assert simhash.keep_one(none).count() == 0


# --- 4 archives ----------------------------------------------------------------------

def test_archives(spark):
    big = "x" * 400 + "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 600
    pages = [(1, "http://a", big), (2, "http://b\r\nEvil: 1", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "a\r\n"),
             (7, "u", "a\r\n"), (None, "u", big), (8, "u", "\r\n\r\n"), (3, None, big)]
    frame = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, payload_digest string")
    got = collections.Counter(tuple(r) for r in warc.archive_round_trip(frame.repartition(3)).collect())
    want = collections.Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        again = html == big and page in (1, 2)
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_payloads_come_back(spark):
    frame = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}\r\n\r\n</p>" * (i % 90)) for i in range(300)],
                                  "page_id long, url string, html string")
    path = warc.new_path(spark, "warc")
    warc.write_archives(frame.repartition(4), path)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert all(back[i] == f"<p>{i}\r\n\r\n</p>" * (i % 90) for i in back) and len(back) >= 200


# --- 5 personal data -----------------------------------------------------------------

def brute_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
             r"\+[0-9][\x20().0-9-]+[0-9]"]
    return [(k, m.start(), m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text or "") if personal.fits(k, m.group())]


def test_base_spans_equal_plain_patterns():
    draw = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(draw.choice(list("a1.@-+ ()95%é")) for _ in range(60))
        assert personal.base_spans(text) == brute_spans(text)
    assert personal.base_spans("9" * 200_000 + "@" + "a@" * 50_000) == []


def test_personal_spans(spark, docs, none):
    for table in (docs, sample(spark)):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        for r in personal.find_personal(table).collect():
            base, whole = ([tuple(s) for s in spans] for spans in (r.base, r["all"]))
            assert base == brute_spans(texts[r.doc_id]) and set(base) <= set(whole)
    assert personal.find_personal(none).count() == 0


def test_personal_counts(spark, tmp_path):
    texts = ["a@b.c d@e.f g@h.i", "1.2.3.4 mail a@b.c 5.6.7.8", "+1 (234) 567 890", "4111 1111 1111 1111 and +12345678901, x@y.z", "none", None,
             "a@b.c 1.2.3.4 4111111111111111 +1 (234) 567 890 a@b.c 1 . 2 . 3 . \u00b2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op5_personal_data(spark, str(tmp_path)).collect():
        spans = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(personal.joined(spans).encode()).hexdigest()
    assert not personal.accept(1, "1.2.3.\u00b2") and personal.accept(1, "1 . 2 . 3 . 4")


def test_tagger_learns_other_spellings():
    draw = np.random.default_rng(1)
    num = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    examples = []
    for i in range(240):
        datum = f"+1 ({num(3)}) {num(3)}-{num(4)}" if i % 2 else f"user{num(2)}@mail{num(1)}.example.com"
        text = f"there over {datum} and then went"
        kind = 3 if i % 2 else 0
        examples.append((text, personal.joined([(kind, 11, 11 + len(datum))]), kind, 11, 11 + len(datum)))
    tagger, hits = personal.fit(examples), 0
    for _ in range(20):
        text = f"there over {num(3)}-{num(3)}-{num(4)} and then went"
        windows = personal.open_windows(text, [])
        hits += (3, 11, 23) in personal.added_spans(windows, tagger.decode([personal.codes(w) for _, w in windows]), [])
    assert hits >= 16


# --- 6 decontamination ---------------------------------------------------------------

def test_decontamination(spark, docs, none):
    item = " ".join(f"item{i}" for i in range(80))
    words = item.split()
    near = " ".join(words[:40] + ["changed"] + words[40:]).upper()
    far = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    texts = [(1, f"a b c {item} d e"), (2, f"x {near}, y"), (3, far), (4, None), (5, ""), (6, "say tiny thing twice"), (7, item), (7, item)]
    table = spark.createDataFrame([(*t, "e") for t in texts], "doc_id long, text string, _th string").repartition(2)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Tiny thing")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(table, items).collect()}
    assert set(got) == {(1, 1), (7, 1), (6, 4), (2, 1)} and got[1, 1].similarity == 1 and got[1, 1].start == 3
    assert got[2, 1].similarity >= 0.8
    assert sorted(r.doc_id for r in decontamination.decontaminate(table, items).collect()) == [3, 4, 5]
    assert decontamination.contaminated(none, items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_the_tables(spark):
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    items = [(r.item_id, collections.Counter(runs(plain(r.text)))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in sample(spark).collect():
        own = runs(plain(r.text))
        for item, c in items:
            n = sum(c.values())
            if sum(x in c for x in own) < 0.5 * n:
                continue
            for i in range(max(1, len(own) - n + 1)):
                w = collections.Counter(own[i:i + n])
                both = sum((w & c).values())
                if both >= 0.8 * (sum(w.values()) + n - both):
                    want.add((r.doc_id, item))
    found = decontamination.contaminated(sample(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want


# --- 7 language ----------------------------------------------------------------------

def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(table).collect()}
    truth = [(r.doc_id, r.lang) for r in table.select("doc_id", "lang").collect()]
    held = [(d, la) for d, la in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, _ in held} == {d for d in got if got[d].held_out}
    assert np.mean([got[d].lang_pred == la for d, la in held]) >= 0.99
    small = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(small[d].lang_pred == "und" and small[d].score == 0 for d in (2, 3, 6, 12)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.keep_identified(docs).columns == docs.columns
    assert language.identify(none).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    table = sample(spark).where("doc_id is not null").select("doc_id", "text", "lang")
    first = table.where(~language.held_out(F.col("doc_id"))).orderBy(F.xxhash64("text")).groupBy("lang").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    copies = first.crossJoin(spark.range(10**9, 10**9 + 200)).selectExpr("id as doc_id", "text", "lang")
    plain, hot = (language.fit(t, sample=40, landmarks=8) for t in (table, table.union(copies)))
    assert plain.langs == hot.langs and np.allclose(plain.matrix, hot.matrix) and np.allclose(plain.bias, hot.bias)


# --- 8 language model ----------------------------------------------------------------

def test_hidden_markov(spark, docs, none):
    for table in (docs, sample(spark)):
        texts = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        tokens = [(d, [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] + [None]) for d, t in texts]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4))
                      for d, ws in tokens)
        got = hidden_markov.score_texts(table).collect()
        assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hidden_markov.score_texts(none).count() == 0


def test_forward_and_counts_are_exact():
    draw = np.random.default_rng(2)
    share = lambda *s: (x := draw.random(s) + 0.1) / x.sum(axis=-1, keepdims=True)
    model = hidden_markov.Model(share(3), share(3, 3), share(3, 5))
    texts = [draw.integers(0, 5, n) for n in (1, 4, 3)]
    starts, emits, logs = np.zeros(3), np.zeros((3, 5)), []
    for text in texts:
        paths = {}
        for path in np.ndindex(*[3] * len(text)):
            p = model.start[path[0]] * model.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], text[t]]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for t, k in enumerate(path):
                emits[k, text[t]] += p / total
    assert np.allclose(hidden_markov.log_likelihoods(model, texts), logs)
    start, _move, emit = hidden_markov.expected_counts(model, texts)
    assert np.allclose(start, starts, atol=1e-4) and np.allclose(emit, emits, atol=1e-4)


def test_every_word_has_its_own_emissions(spark):
    """Two rare words of one count, of unlike topics and of one hash class of 500, below 2,100 frequent ones."""
    draw = np.random.default_rng(5)
    free, unseen = [[d for d in range(20_000) if (zlib.crc32(str(d).encode()) % 7 == 2) == held] for held in (False, True)]
    texts = []
    for topic in "ab":
        names = [f"{topic}{i}" for i in range(1500)] * 6
        draw.shuffle(names)
        frequent = [f"{topic}f{i}" for i in range(1050)] * 20
        draw.shuffle(frequent)
        texts += [" ".join([*names[k::300], *frequent[k::300]]) for k in range(300)]
    classes = collections.defaultdict(dict)
    for i in range(1500):
        for topic in "ab":
            classes[zlib.crc32(f"{topic}{i}".encode()) % 500].setdefault(topic, f"{topic}{i}")
    pairs = [(c["a"], c["b"]) for c in classes.values() if len(c) == 2][:20]
    assert len(pairs) == 20
    stem = " ".join(f"af{i}" for i in range(30))
    held = [f"{stem} {word}" for pair in pairs for word in pair]
    table = spark.createDataFrame([*zip(free, texts), *zip(unseen, held)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in hidden_markov.score_texts(table.repartition(5)).collect()}
    scores = [got[d] for d, _ in zip(unseen, held)]
    assert all(own > other + 0.3 for own, other in zip(scores[::2], scores[1::2]))
    again = {r.doc_id: r.score for r in hidden_markov.score_texts(table.repartition(1)).collect()}
    assert all(again[d] == pytest.approx(got[d], rel=1e-3) for d in got)


# --- 9 repeated passages -------------------------------------------------------------

def test_repeated_runs(spark, docs, none):
    first, want = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows()}, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(t or "")
        for i in range(len(words) - 49):
            run = tuple(words[i:i + 50])
            if run in first:
                want.setdefault(d, set()).update(range(i, i + 50))
            first.add(run)
    got = collections.defaultdict(set)
    for r in lines.repeated_runs(docs).collect():
        got[r.doc_id] |= set(range(r.start, r.start + r.words))
    assert dict(got) == want and 8 in want and 5 in want
    left = {r.doc_id: r for r in lines.delete_repeats(docs).collect()}
    assert 5 not in left and left[8].text == "Other words, and more" and PARA in left[7].text and left[8].n_chars == 21
    assert left[2].text is None and left[3].text == "" and left[8].kept == "x"
    assert lines.repeated_runs(none).count() == 0 and lines.delete_repeats(none).count() == 0


# --- 10 URLs -------------------------------------------------------------------------

def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in urls.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else (None, None)


def test_urls(spark, none):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "no scheme/de/"), (-4, "http://WWW.Example.ORG/en/12?x#y"), (-5, "a://b://c/d"),
                                 (-6, "http://xorg/"), (-7, "http://org"), (-8, "https://a.com/de/\nx"), (-1, None)], "page_id long, url string")
    whole = table.unionByName(odd)
    texts = {r.page_id: r.url for r in whole.collect()}
    got = urls.filter_urls(whole).collect()
    assert len(got) == whole.count()
    for r in got:
        host, path, (rule, verdict) = brute_rule(texts[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.filter_urls(odd.limit(0)).count() == 0


def test_url_judge_on_unseen_urls():
    good = [f"https://www.site{i}.example.org/en/{i}" for i in range(400)]
    bad = [f"http://free-bets.example.com/casino/{i}?ref=x" for i in range(400)]
    judge = urls.UrlJudge(good[:300], bad[:300])
    assert all(judge.score(u) >= judge.limit for u in good[300:]) and all(judge.score(u) < judge.limit for u in bad[300:])
    total = sum(math.exp(urls.MarkovModel(2).fit(["ab", "aab"]).log_likelihood(t)) for t in ("", "a", "b", "ab", "aab"))
    assert 0 < total < 1


# --- pipeline ------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    table = sample(spark)
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{corpus_pipeline.shared_folder(spark)}/test-{len(kept.columns)}-{hash(stage) % 10**9}"
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == ids
    assert decontamination.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert lines.repeated_runs(kept).count() == 0
    assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count() == 0
