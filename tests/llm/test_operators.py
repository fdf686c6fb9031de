"""Each operator against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chat, decontaminate, fingerprint, jaccard_join, language, line_dedup, packing, quality, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, edge cases."""
    base, passage = words(1, 300), words(2, 70)
    texts = [" ".join(base), " ".join(base), None, "", "one", "one two", " \n\t", "É ß\x1c 日本 語", "one two"]
    for k in range(12):
        near = list(base)
        near[20 + 20 * k] = f"edit{k}"
        texts.append(" ".join(near))
    for k in range(8):
        texts.append(" ".join(words(10 + k, 60) + passage + words(30 + k, 60)))
    texts.append(" ".join(words(50, 20_000, 5_000)))
    texts += [" ".join(words(60 + k, 120)) for k in range(10)]
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 12}", len(t or "")) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ 1
def naive_phrases(text):
    seen, ends, at = set(), [], 0
    for i in range(1, len(text) + 1):
        if text[at:i] not in seen:
            seen.add(text[at:i])
            ends.append(i)
            at = i
    return ends + ([len(text)] if at < len(text) else [])


def test_phrases_and_pairs():
    for _, t in corpus():
        t = (t or "")[:3000]
        assert fingerprint.parse(t)[0] == naive_phrases(t)
    a, b = "abcabcabd" * 50, "abcabcabd" * 25 + "zzyzx" * 40
    same = 225
    assert [list(x) for x in fingerprint.fingerprint_pair(a, b, same)] == [list(fingerprint.fingerprint(a)), list(fingerprint.fingerprint(b))]


def test_fingerprints_of_neighbours(spark, monkeypatch):
    data = corpus()
    for per_range in (2000, 4):
        monkeypatch.setattr(fingerprint.with_next, "__defaults__", ("doc_id", "text", per_range))
        got = {r.doc_id: r for r in fingerprint.compare_with_edits(frame(spark, data)).collect()}
        order = sorted(data, reverse=True)
        assert len(got) == len(data)
        for k, (i, t) in enumerate(order):
            own, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + nxt[:half]
            fp, other, after = (fingerprint.fingerprint(x) for x in (own, edited, nxt))
            assert got[i].n_chars == len(own) and got[i].fingerprint == fingerprint.written(fp) and got[i].edited_fingerprint == fingerprint.written(other)
            assert got[i].near_edited == pytest.approx(fingerprint.likeness(fp, other)) and got[i].near_next == pytest.approx(fingerprint.likeness(fp, after))
    assert got[0].fingerprint == got[3].fingerprint


def test_fingerprint_edges(spark):
    assert fingerprint.compare_with_edits(empty(spark)).count() == 0
    assert fingerprint.compare_with_edits(frame(spark, [(5, "ab")])).first().near_next == 1.0
    assert fingerprint.compare_with_edits(frame(spark, [(5, "ab"), (5, "ab"), (None, "x"), (None, None)])).count() == 4
    clash = frame(spark, corpus()).withColumn("fingerprint", F.lit(1)).withColumn("range", F.lit(2))
    assert fingerprint.fingerprints(clash).select("fingerprint").count() == len(corpus())


# ------------------------------------------------------------------ 2
@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup(spark, batches):
    data = corpus()
    got = rows(substring_dedup.report(frame(spark, data), batches=batches, most_runs=2))
    assert got == sorted(substring_dedup.brute_force(data), key=repr)
    assert sum(r[2] for r in got) > 1000


def test_substring_dedup_edges(spark):
    assert substring_dedup.report(empty(spark)).count() == 0
    text = " ".join(words(1, 60))
    data = [(1, text), (1, text), (None, text), (None, text), (2, text + " tail")]
    got = rows(substring_dedup.report(frame(spark, data)))
    assert got == sorted(substring_dedup.brute_force(data), key=repr)
    kept = {r.doc_id: r.kept_text for r in substring_dedup.kept_texts(frame(spark, data)).collect()}
    assert kept[1] == text and kept[2] == "tail" and kept[None] == ""


def test_substring_dedup_with_full_sets(spark, monkeypatch):
    """Where all sets are full, no more windows are compared than where they are large."""
    data = corpus()
    n, save = {}, substring_dedup.Scratch.save

    def counted(self, df, name, **options):
        out = save(self, df, name, **options)
        if name.startswith("windows-"):
            n.setdefault(bits, []).append(out.count())
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "save", counted)
    for bits in (27, 6):
        monkeypatch.setattr(substring_dedup, "SET_BITS", bits)
        got = rows(substring_dedup.report(frame(spark, data), batches=2))
        assert got == sorted(substring_dedup.brute_force(data), key=repr)
    assert n[6] == n[27] and max(n[6]) < 6_000  # of 27,000 windows, most in a text that shares none


# ------------------------------------------------------------------ 3
def line_brute(data, min_sites):
    sites = {}
    for i, t in data:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" "), set()).add(f"s{(i or 0) % 12}")
    out = {}
    for i, t in data:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites]
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_line_dedup(spark):
    data = [(k, "\n".join([f"own {k}", "everywhere" if k % 13 else " everywhere ", "", f"in six {k % 2}", "one site" if k % 12 == 0 else "x", ""])) for k in range(60)] + [(100, None), (101, ""), (102, "\n")]
    for least in (4, 6, 7, 12):
        made = line_dedup.drop_spread_lines(frame(spark, data).withColumn("h1", F.lit(1)), min_sites=least)
        got = {r.doc_id: r for r in made.collect()}
        assert {i: r.text for i, r in got.items()} == line_brute(data, least)
        assert got[100].n_lines == 0 and got[101].n_lines == 1 and got[0].h1 == 1
    assert line_dedup.report(empty(spark)).count() == 0


# ------------------------------------------------------------------ 4
def test_decontamination(spark, monkeypatch):
    items = [(1, " ".join(words(2, 70)[:30])), (2, "One  TWO"), (3, "three"), (4, None), (5, ""), (10, " ".join(words(1, 300)[100:140]).upper()), (2, "One  TWO"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = corpus() + [(900, "x One two y three"), (901, "ONE, two: ûber"), (902, "One")]
    expected = sorted(decontaminate.brute_force(data, items), key=repr)
    assert next(x for x in expected if x[0] == 902)[1:4] == (1, 1, 0)  # of the item without an id
    for most in (100_000, 0):
        assert rows(decontaminate.report(frame(spark, data), bench, broadcast_rows=most)) == expected
    assert sum(r[5] for r in expected) > 8
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert decontaminate.report(frame(spark, data), bench.limit(0)).where("contaminated").count() == 0
    # full sets let everything through, and names of further columns may clash
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    more = frame(spark, data).withColumn("found", F.lit("own")).withColumn("n_words", F.lit("clash")).withColumn("k1", F.lit("key")).withColumn("words", F.lit("w"))
    for most in (100_000, 0):
        got = decontaminate.find_contamination(more, bench, broadcast_rows=most)
        assert got.columns == [*[c for c in more.columns if c != "n_words"], "n_words", "hit_words", "hit_items"]
        cut = got.select("doc_id", "n_words", decontaminate.n_hit().alias("n"), F.size("hit_items").cast("long").alias("i"), "found", "k1").collect()
        assert sorted(((*r[:4],) for r in cut), key=repr) == [x[:4] for x in expected]
        assert {(r.found, r.k1) for r in cut} == {("own", "key")}


# ------------------------------------------------------------------ 5
def test_quality_fit_memory():
    """The fit holds little more than the features, 4 bytes each."""
    r = np.random.default_rng(3)
    grades = np.arange(2_000) % 3
    ids = [np.unique(r.integers(0, 4_000, 600) + 300 * g).astype(np.int32) for g in grades]
    n = sum(map(len, ids))
    tracemalloc.start()
    model = quality.train(ids, grades, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    score = np.array([model.weights[x].sum() for x in ids])
    assert score[grades == 0].mean() < score[grades == 1].mean() < score[grades == 2].mean()


def test_quality(spark):
    r = random.Random(3)
    data, grades = [], []
    for i in range(600):
        g = i % 3
        t = words(1000 + i, 80) + [["vile", "awful"], ["||", "||"], ["fine", "good"]][g] * r.randrange(1, 4)
        data.append((i, " ".join(t)))
        grades.append((i, g))
    data += [(1000, None), (1001, ""), (0, data[0][1])]
    docs, ratings = frame(spark, data).withColumn("keep", F.lit("clash")), spark.createDataFrame([*grades[:450], (5, None), (None, 1), (77777, 0)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    held = [got[i] for i in range(450, 600)]
    assert sum(x.keep == (x.doc_id % 3 == 2) for x in held) > 140
    assert all(0 <= x.p_tail <= 1 and 0 <= x.expected_grade <= 2 for x in held)
    assert not got[1000].keep and not got[1001].keep
    assert quality.fit(docs, ratings.limit(0)) is None
    assert {x.doc_id for x in quality.score(docs, None).where("not keep").collect()} == {1000, 1001}
    assert quality.score(empty(spark), model).count() == 0


# ------------------------------------------------------------------ 6
def test_language(spark):
    r = random.Random(5)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["eau", "oi", "que", "lle"]}
    say = lambda name, n: " ".join("".join(r.choice(parts[name]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    data = [(i, say(name, 40), name) for i, name in enumerate(sorted(parts) * 60)]
    docs = spark.createDataFrame([*data, (900, None, "aa"), (901, "12 34", "bb"), (902, "kato", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(7))
    counts = language.learn(docs.where(~language.held_out("doc_id")))
    got = {x.doc_id: x for x in language.identify(docs, counts).collect()}
    assert sum(got[i].lang_pred == name for i, _, name in data) == len(data)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and 0 <= got[902].score <= 1
    mixed = spark.createDataFrame([(1, say("aa", 60) + " " + say("cc", 30), None)], "doc_id long, text string, lang string")
    shares = language.identify(mixed, counts).first().lang_shares
    assert set(shares) == {"aa", "cc"} and shares["aa"] == pytest.approx(2 / 3, abs=0.1)
    assert {x.lang_pred for x in language.identify(docs, []).collect()} == {"und"}
    assert language.learn(docs.limit(0)) == []


def test_mixture_against_brute_force():
    """The shares against a fine grid; the choice against all sets of languages."""
    import itertools

    import numpy as np

    r = np.random.default_rng(8)
    like = lambda logs, counts, shares: float(counts @ np.log(np.exp(logs) @ shares))
    grid = [np.array([a, b, 60 - a - b]) / 60 for a in range(61) for b in range(61 - a)]
    for case in range(6):
        # words of which each is likelier in one language, in proportions that differ by case
        own = r.choice(3, 300, p=[[1, 0, 0], [0.6, 0.4, 0], [0.3, 0.4, 0.3], [0.97, 0.03, 0], [0.9, 0.05, 0.05], [0.99, 0.005, 0.005]][case])
        logs = np.log(np.where(np.arange(3) == own[:, None], 0.02, 0.002) * r.uniform(0.5, 1.5, (300, 3)))
        counts = r.integers(1, 4, 300).astype(float)
        shares, reached, missing = language.mixture(logs, counts)
        assert reached == pytest.approx(like(logs, counts, shares)) and missing <= language.TOLERANCE
        assert reached >= max(like(logs, counts, g) for g in grid) - language.TOLERANCE
        price = language.PENALTY * np.log(1 + counts.sum())
        worth = {m: language.mixture(logs[:, m], counts)[1] - price * len(m) for k in (1, 2, 3) for m in itertools.combinations(range(3), k)}
        assert tuple(sorted(language.choose(logs, counts)[0])) == max(worth, key=worth.get)


def test_language_of_a_small_share_is_kept():
    import numpy as np

    # one word in 200, but impossible in the other languages
    own = np.arange(4000) % 200 == 0
    logs = np.log(np.stack([np.where(own, 1e-9, 0.01), np.where(own, 0.01, 1e-9), np.full(4000, 1e-6)], axis=1))
    members, shares = language.choose(logs, np.ones(4000))
    assert members == [0, 1] and shares[1] == pytest.approx(0.005, abs=1e-4)


def test_language_of_empty_tables_and_long_texts(spark):
    counts = [("aa", " ka", 5), ("bb", " to", 5)]
    assert language.identify(empty(spark), counts).count() == 0
    long = spark.createDataFrame([(1, "ka " * 400_000), (2, "ka")], "doc_id long, text string")
    assert {x.lang_pred for x in language.identify(long, counts).collect()} == {"aa"}


def test_held_out(spark):
    import zlib

    got = {x.doc_id: x.h for x in spark.range(50).select(F.col("id").alias("doc_id"), language.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


# ------------------------------------------------------------------ 7
def test_chat(spark):
    r = random.Random(7)
    data, by = [], {}
    for c in range(60):
        roles = [r.choice(["system", "user", "assistant", "tool", None, "user"]) for _ in range(r.randrange(1, 7))]
        by[c] = roles
        data += [(c, k, role, None if r.random() < 0.1 else f"t{c}.{k}") for k, role in enumerate(roles)]
    long_ = [r.choice(["user", "assistant", "user"]) for _ in range(400)]
    data += [(500, k, role, f"m{k}") for k, role in enumerate(long_)]
    shape = "conv_id long, turn long, role string, text string"
    got = {}
    for partitions in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        out = chat.repair(spark.createDataFrame(data, shape)).collect()
        got[partitions] = sorted((tuple(x) for x in out), key=lambda x: (x[0], x[1]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["4"] == got["23"]
    for c, roles in by.items():
        mine = [x for x in got["4"] if x[0] == c]
        assert sum(chat.cost_of(x[4], x[5]) for x in mine) == chat.least_cost(roles)
        state, said = "start", "".join(x[6] for x in mine)
        for x in mine:
            for role in [*x[5], *([] if x[4].startswith("merge") else [x[3]])]:
                assert role in chat.NEXT[state]
                state = role
        assert said.count("<|im_start|>") == said.count("<|im_end|>") and said.endswith("<|im_end|>\n")
    assert chat.repair(spark.createDataFrame([], shape)).count() == 0


# ------------------------------------------------------------------ 8
@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, n, percent):
    data = corpus()
    assert rows(jaccard_join.cluster(frame(spark, data), n=n, percent=percent)) == sorted(jaccard_join.brute_force(data, n, percent), key=repr)


def test_jaccard_chain_and_edges(spark):
    base = words(9, 200)
    data = []
    for k in range(12):  # neighbours link, the ends don't
        base = [*base[:15 * k], *(f"c{k}.{j}" for j in range(3)), *base[15 * k + 3 :]]
        data.append((k, " ".join(base)))
    expected = sorted(jaccard_join.brute_force(data), key=repr)
    assert rows(jaccard_join.cluster(frame(spark, data))) == expected
    assert jaccard_join.cluster(empty(spark)).count() == 0
    twice = [(1, "a b c d"), (1, "a b c d"), (2, "A B c d"), (None, "a b c d"), (3, None), (4, "")]
    assert rows(jaccard_join.cluster(frame(spark, twice))) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3), (4, 0, 4)], key=repr)


def all_links(data, n=3, percent=90):
    """doc_id, class_id, n_links, from all pairs."""
    sets = []
    for _, text in data:
        w = jaccard_join.lower_space_words(text)
        sets.append(frozenset({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else ()))
    out = []
    for i, (doc, _) in enumerate(data):
        same = [d for (d, _), s in zip(data, sets, strict=True) if s == sets[i] and d is not None] if sets[i] else [doc]
        links = sum(bool(sets[i] and s) and 100 * len(sets[i] & s) >= percent * len(sets[i] | s) for k, s in enumerate(sets) if k != i)
        out.append((doc, min(same, default=None), links))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 512), (3, 90, 4), (5, 80, 3), (1, 50, 512)])
def test_jaccard_counts_all_links(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    base = words(9, 200)
    group = [" ".join([*base[: 3 * k], f"g{k}", *base[3 * k + 1 :]]) for k in range(40)]
    data = [*corpus(), *((900 + k, t) for k, t in enumerate(group)), (None, group[0]), (899, group[1].upper()), (None, None)]
    got = jaccard_join.cluster_links(frame(spark, data), n=n, percent=percent)
    assert rows(got.select("doc_id", "class_id", "n_links")) == all_links(data, n, percent)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == rows(jaccard_join.cluster(frame(spark, data), n=n, percent=percent))
    if (n, percent) == (3, 90):
        assert got.where("doc_id = 905").first().n_links == 41  # 39 near copies, two of them twice


def test_jaccard_links_of_no_rows_and_none(spark):
    assert jaccard_join.cluster_links(empty(spark)).count() == 0
    assert rows(jaccard_join.cluster_links(frame(spark, [(1, "a b c d"), (2, "x y z"), (3, None)]))) == [(1, 2, 1, 1, 0), (2, 1, 2, 2, 0), (3, 0, 3, 3, 0)]


# ------------------------------------------------------------------ 9
def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_paths()[0])
    data = [*corpus(), (800, "two  blanks \n and <|endoftext|> mark"), (801, " lead"), (802, "trail "), (803, "a\n b\t\tc  "), (804, "नमस्ते दुनिया"), (0, "again")]
    got = packing.pack(frame(spark, data)).collect()
    import collections

    import numpy as np

    wanted = collections.Counter()
    for i, t in data:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        at, to, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            import zlib

            wanted[i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, to, k = to, to + 1024, k + 1
    assert collections.Counter(tuple(r)[:5] for r in got) == wanted
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(spark)).count() == 0


def test_tokens_of_distinct_parts_are_encoded_in_few_calls():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_paths()[0])
    tokens, r, sizes = packing.TokenBytes(*packing.tokenizer_paths()), random.Random(5), []
    ordinary = tokens.fast.encode_ordinary
    tokens.fast.encode_ordinary = lambda text: sizes.append(len(text)) or ordinary(text)
    words = ["".join(r.choice("aeionrst") for _ in range(9)) for _ in range(3000)]
    texts = ["Text " + " ".join(r.choices(words, k=400)) for _ in range(40)]
    assert list(tokens.encode(pa.array(texts))) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    # a word was a call: some 3,000; now all that repeats is encoded once, in one call and one for the first word
    assert len(sizes) <= 3 and sum(sizes) <= 31_000


def test_tokens_of_odd_texts(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_paths()[0])
    tokens, r = packing.TokenBytes(*packing.tokenizer_paths()), random.Random(3)
    atoms = [*"        \n\t\x0b\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000", "\r\n", "'s", "’", "–", "à", "ɏ", "ɐ", "नमस्ते", "中文", "\U0001f600", "a", "the", "42", "²", "&&&", "\0", packing.TokenBytes.SPECIAL, "<|endof", "text|>"]
    texts = [None, "", *("".join(r.choices(atoms, k=r.choice([1, 2, 9, 40]))) for _ in range(400)), None]
    wanted = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for run, call, block in ((1, 1, 1), (900, 20, 7), (1 << 22, 1 << 17, 1 << 18)):
        for name, value in (("RUN", run), ("CALL", call), ("BLOCK", block)):
            monkeypatch.setattr(packing.TokenBytes, name, value)
        for kind in (pa.string(), pa.large_string()):
            assert list(tokens.encode(pa.array(texts, kind))) == wanted
            assert list(tokens.encode(pa.array(texts, kind)[3:77])) == wanted[3:77]
        assert list(tokens.encode(pa.array([], pa.string()))) == [] and list(tokens.encode(pa.array([None, ""]))) == [b"", b""]


def test_undominated_fillings():
    bits = lambda sizes: sum(1 << x for x in sizes)
    # (10,) leaves room for the free 60; 30 and 20 can give way to the free 50
    assert packing.fillings(100, bits([60, 10]), {60: 1, 10: 1}, 1500) == ([(30, (60, 10))], True, 3)
    assert [x for _, x in packing.fillings(55, bits([50, 30, 20]), {50: 1, 30: 1, 20: 1}, 1500)[0]] == [(50,)]
    assert packing.fillings(5, bits([7]), {7: 2}, 1500)[0] == [(5, ())]
    assert sum(m for _, m in packing.complete({7: 1, 5: 1, 4: 1, 3: 2, 2: 1}, 12)) == 2


def test_bin_completion_is_least():
    r = random.Random(11)

    def least(items, capacity):
        best = [len(items)]

        def place(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                    place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
            place(k + 1, [*rooms, capacity - items[k]])

        place(0, [])
        return best[0]

    exact = 0
    for _ in range(60):
        items = sorted((r.randrange(1, 60) for _ in range(r.randrange(1, 11))), reverse=True)
        counts = {s: items.count(s) for s in items}
        patterns = packing.complete(counts, 64)
        assert {s: sum(dict(p).get(s, 0) * m for p, m in patterns) for s in counts} == counts
        assert all(sum(s * n for s, n in p) <= 64 for p, _ in patterns)
        exact += sum(m for _, m in patterns) == least(items, 64)
    assert exact == 60


# ------------------------------------------------------------------ 10
def test_url_filter(spark):
    links = '<a href="https://b.example.org/x">b</a> <A HREF=//c.example.org/y>c</A> <a href="/own">own</a>'
    data = [
        (1, "https://www.Example.COM/en/a?q#f", None), (2, "http://a.example.com/en/x", ""), (3, "https://x.net/es/1", '<a href="http://d.example.org">d</a>'), (4, "https://x.net/es/2", links),
        (5, "http://y.net/fr/z#t", None), (6, "https://good.com/", links), (7, "https://b.example.org/p", '<a href="http://x.net/es/1">to</a>'), (8, "https://c.example.org/p", None),
        (9, None, links), (10, "no scheme", links), (11, "https://host", None), (12, "https://d.example.org?x", '<a href="http://y.net/fr/q">'), (12, "https://d.example.org?x", '<a href="http://y.net/fr/q">'),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.report(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict, got[6].rule) == ("example.com/en/", "block", "com/")
    assert (got[3].rule, got[5].rule, got[11].path) == ("net/es/", "net/fr/", "")
    assert (got[9].host, got[9].path, got[10].host, got[9].verdict) == ("", "", "", "allow")
    assert got[12].verdict == "block" and got[8].verdict == "allow"
    ranks = {r.host: (r.trust, r.distrust) for r in url_filter.judge(pages, broadcast_hosts=0).collect()}
    assert ranks["d.example.org"][1] > 0 and ranks["c.example.org"][0] > 0
    assert url_filter.report(pages.limit(0)).count() == 0


def test_page_rank_against_brute_force(spark):
    r = random.Random(2)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): r.randrange(1, 4) for a in hosts for b in hosts if a != b and r.random() < 0.25}
    total = {a: sum(n for (x, _), n in edges.items() if x == a) for a in hosts}
    links = spark.createDataFrame([("trust", a, b, n / total[a]) for (a, b), n in edges.items()], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", "h0", 1.0), ("trust", "h3", 1.0)], "kind string, host string, seed double")
    rank = {h: float(h in ("h0", "h3")) for h in hosts}
    for _ in range(200):
        rank = {h: 0.15 * (h in ("h0", "h3")) + 0.85 * sum(rank[a] * n / total[a] for (a, b), n in edges.items() if b == h) for h in hosts}
    got = {x.host: x.rank for x in url_filter.propagate(links, seeds, 0.85, 1e-9, every=3).collect()}
    assert all(got.get(h, 0) == pytest.approx(rank[h], abs=1e-8) for h in hosts)
