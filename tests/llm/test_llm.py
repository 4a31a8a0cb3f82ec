"""Each training-data operator against brute force on small fixtures, with nulls, empty and long texts, ties and repeats."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, `__key` string, part int"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


def corpus():
    r = np.random.default_rng(7)
    vocab = ["the", "of", "and", *("".join(r.choice(list("abcdeilnorst"), 4)) for _ in range(400))]
    text = lambda n: " ".join(r.choice(vocab, n))
    base = [text(int(n)) for n in r.integers(1, 120, 30)] + [text(900)]
    rows = []
    for t in base:
        rows.append(t)
        w = t.split()
        for _ in range(int(r.integers(0, 3))):
            v = list(w)
            v[int(r.integers(0, len(v)))] = "changed"
            rows.append(" ".join(v))
    boiler = "this line of boilerplate text\nis part of many many documents\nas everybody can see here"
    rows += [f"{text(20)}\n{boiler}\n{text(15)}" for _ in range(6)]
    rows += [None, "", "  \n\t", "Word", "word", "two words", "Two words", base[0], base[0], "x" * 5000, "<|endoftext|> a b Été 日本"]
    langs, sources = ["en", "fr", None], ["s1", "s2", None, "sé", "S1"]
    return [(i, t, langs[i % 3], sources[int(r.integers(0, 5))], "k", i % 4) for i, t in enumerate(rows)] + [(None, "no id here at all", "en", "s1", "k", 0)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = corpus()
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path), spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark, docs):
    """Against all pairs of places: short lines in long runs, single lines, extension both ways, self-overlap."""
    from palimpsest.llm.lines import dedup_lines

    r = np.random.default_rng(3)
    pool = [" ".join(r.choice(["a", "b", "c"], int(n))) for n in (1, 1, 2, 3, 4, 4, 12, 30)] + ["", " "]
    verse = "\n".join(f"v{i} b c d" for i in range(20))
    texts = [verse, f"x\n{verse}\ny", "one two three\nfour five six\n" + "z " * 30 + "\ne", "q\none two three\nfour five six\n" + "z " * 30 + "\nf", "k l m n\n" * 9, None]
    texts += ["\n".join(f"f{i} g h j" for i in range(12))] * 2
    texts += ["\n".join(r.choice(pool, int(n))) for n in r.integers(1, 14, 60)] + [t for _, t, *_ in docs[0]]
    full = [[(n, x, len(words(x))) for n, x in enumerate((t or "").split("\n")) if words(x)] for t in texts]
    places = [(d, i) for d, lines in enumerate(full) for i in range(len(lines))]
    at, gone = collections.defaultdict(list), collections.defaultdict(set)
    for d, i in places:
        line = full[d][i][1]
        for e, j in at[line]:
            if i and j and full[d][i - 1][1] == full[e][j - 1][1]:
                continue  # not where the run starts
            m = 0
            while i + m < len(full[d]) and j + m < len(full[e]) and full[d][i + m][1] == full[e][j + m][1]:
                m += 1
            if sum(k for *_, k in full[d][i : i + m]) >= 10:
                gone[d] |= {n for n, *_ in full[d][i : i + m]}
        at[line].append((d, i))
    clash = spark.createDataFrame([(d, t, "k", d, "m") for d, t in enumerate(texts)], "doc_id bigint, text string, __loc string, fkey int, _metadata string")
    rows = {x["doc_id"]: x for x in dedup_lines(clash).collect()}
    assert {d: set(x["__gone"]) for d, x in rows.items()} == {d: gone[d] for d in range(len(texts))}
    for d, t in enumerate(texts):
        assert rows[d]["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])) and rows[d]["__loc"] == "k" and rows[d]["fkey"] == d
    assert dedup_lines(docs[2]).count() == 0
    assert len(gone[1]) == 20 and gone[3] == {1, 2, 3} and len(gone[4]) == 8 and len(gone[7]) == 12


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    from palimpsest.llm.tokens import count_tokens, load

    rows, df, empty = docs
    path = public_tokenizers.path(name)
    tok = load(path)
    encode = (lambda t: tok.encode(t)) if name.endswith(".model") else (lambda t: tok.encode(t, add_special_tokens=False).ids)
    got = {r[0]: tuple(r[1:]) for r in count_tokens(df, path, limit=50).collect()}
    assert got == {d: (len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 50) for d, t, *_ in rows}
    assert count_tokens(empty, path).count() == 0


def test_mixing(docs):
    from palimpsest.llm.mixing import Mix

    rows, df, empty = docs
    size = collections.Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, full = 1.5 * sum(size.values()), set()
    while True:
        level = (want - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    mix = Mix(df)
    target = {r["source"]: r["target"] for r in mix.targets.collect()}
    for s in order:
        assert math.isclose(target["z" if s is None else "a" + s], 2 * size[s] if s in full else weight[s] * level)
    got = mix.decisions().collect()
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and len(r["sources"]) == r["copies"]
        taken[r["pattern"][0]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[k] - v) <= 60 for k, v in target.items())
    again = Mix(df.repartition(5)).decisions().select("id", "taken").collect()
    assert sorted((r["id"] or -1, r["taken"]) for r in got) == sorted((r["id"] or -1, r["taken"]) for r in again)
    out = mix.apply(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert Mix(empty).decisions().count() == 0


def test_min_cost_flow():
    from palimpsest.llm.mixing import solve_flow

    capacity, quota = {("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 15, "b": 20}
    flow = solve_flow(capacity, quota, 2)
    def cost(f):
        used = {p: sum(x.values()) for p, x in f.items()}
        return sum(used.values()), sum(max(0, used[p] - capacity[p]) for p in capacity)
    best = (0, 0)
    for a1, a2, b2, b1 in itertools.product(range(16), range(16), range(21), range(9)):
        if a1 + a2 <= 15 and b1 + b2 <= 20 and a1 <= 20 and a2 + b2 <= 20:
            c = cost({("a",): {"a": a1}, ("a", "b"): {"a": a2, "b": b2}, ("b",): {"b": b1}})
            best = max(best, c, key=lambda x: (x[0], -x[1]))
    assert cost(flow) == best


def test_overlapping_sources(spark):
    from palimpsest.llm.mixing import Mix

    rows = [(i, "w " * (1 + i % 5), [["a"], ["a", "b"], ["b", None], []][i % 4]) for i in range(80)]
    mix = Mix(spark.createDataFrame(rows, "doc_id int, text string, source array<string>"), weights=(1, 2, 1), share=1.0)
    by = collections.Counter()
    for r in mix.decisions().collect():
        for s in r["sources"]:
            by[s] += r["size"]
    for r in mix.targets.collect():
        assert abs(by[r["source"][1:]] - r["target"]) <= 12


def crc_mod(column):
    from pyspark.sql import functions as F

    return (F.crc32(column.cast("binary")) % 3).cast("string")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    from palimpsest.llm.dedup import exact_dedup, sha256
    from pyspark.sql import functions as F
    import hashlib

    rows, df, empty = docs
    digest = (lambda c: F.encode(crc_mod(c), "utf-8")) if weak else sha256
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(df, digest=digest).collect()}
    for t, ids in groups.items():
        keep = max(ids, key=lambda d: (d is not None, d))
        for d in ids:
            assert got[d] == (keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_state_continues_and_repeated_rows(spark, tmp_path):
    from palimpsest.llm.common import located
    from palimpsest.llm.dedup import DedupState, exact_dedup

    state = DedupState(spark, str(tmp_path / "s"))
    for rows in ([(1, "a"), (2, "b")], [(3, "a"), (3, "a")]):
        state.add(located(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted((r["keep"]["id"], r["n"]) for r in state.groups().collect()) == [(2, 1), (3, 3)]
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    assert sorted((r["group_size"], r["kept"]) for r in exact_dedup(same).collect()) == [(1, True), (2, False), (2, True)]


@pytest.mark.parametrize("hot", [False, True])
def test_ngram_jaccard(docs, monkeypatch, hot):
    from palimpsest.llm import jaccard as J

    if hot:  # everything that occurs twice counts as frequent
        monkeypatch.setattr(J, "HOT_COUNT", 1)
        monkeypatch.setattr(J, "HOT_LOCAL", 1)
    rows, df, empty = docs
    sets = []
    for d, t, *_ in rows:
        w = words(lower(t))
        sets.append((d, {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    link = collections.defaultdict(set)
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 70 * len(a | b):
            link[i].add(j)
            link[j].add(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in J.jaccard_groups(df).collect()}
    for i, (d, s) in enumerate(sets):
        reach, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - reach
            reach |= new
            todo += new
        assert got[d] == (len(s), len(link[i]), min((sets[x][0] for x in reach if sets[x][0] is not None), default=d)), d
    assert J.jaccard_groups(empty).count() == 0


def test_signatures_lose_no_pair():
    from palimpsest.llm import jaccard as J

    r, t = np.random.default_rng(3), J.Threshold(70, 100)
    for _ in range(400):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.85], r.integers(0, 2**64, int(r.integers(0, n // 4 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 70 * (len(a) + len(b) - both):
            continue
        cold = lambda h: h % np.uint64(3) == 0
        sig = [np.concatenate([s for s, _ in J.signatures(h, cold(h), t)]) for h in (a, b)]
        assert len(np.intersect1d(*sig)), (len(a), len(b), both)
        assert J.unequal(J.parity(a), J.parity(b)) <= len(np.setxor1d(a, b))


def test_embeddings(spark):
    from palimpsest.llm.embeddings import near_dedup

    r = np.random.default_rng(4)
    x = r.standard_normal((300, 24))
    near = x[:40].repeat(2, 0) + r.standard_normal((80, 24)) * 0.2
    vectors = [list(map(float, v)) for v in np.concatenate([x, near, x[:3]])]
    vectors += [[1.0, 1.0], [2.0, 2.0], [1.0, -1.0], [1.0] * 3, [1.0, 1.0, 1.05]]
    vectors += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, unit string")
    short = range(len(vectors) - 12, len(vectors) - 7)
    good = [i for i, v in enumerate(vectors) if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.array([vectors[i] for i in good])
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.9).sum(1) - 1
    got = {row["vec_id"]: row for row in near_dedup(df).collect()}
    found = sum(got[i]["n_links"] for i in good)
    assert len(got) == len(vectors) and found >= 0.9 * linked.sum() and all(got[i]["n_links"] <= n for i, n in zip(good, linked))
    assert [got[i]["n_links"] for i in short] == [2, 2, 0, 1, 1] and [got[i]["component_id"] - short[0] for i in short] == [0, 0, 2, 3, 3]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(vectors) - 7, len(vectors) - 1))
    assert near_dedup(df.where("false")).count() == 0


def test_ngram_scores(docs):
    from palimpsest.llm.scoring import MU, ladder, ngram_scores

    rows, df, empty = docs
    depths = [d for r in ladder(max(len((t or "").encode()) for _, t, *_ in rows) // 2 + 1) for d in r]
    texts = {d: (zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, [*words(lower(t)), None]) for d, t, *_ in rows}
    uni, context, both = collections.Counter(), collections.Counter(), collections.Counter()
    for held, w in texts.values():
        if not held:
            uni.update(w)
            for t in range(len(w)):
                for k in depths:
                    if k > t:
                        break
                    context[tuple(w[t - k : t])] += 1
                    both[tuple(w[t - k : t]), w[t]] += 1
    n, v = sum(uni.values()), len(uni)
    for r in ngram_scores(df).collect():
        held, w = texts[r["doc_id"]]
        p = [(uni[x] + 1) / (n + v + 1) for x in w]
        score = 0.0
        for t in range(len(w)):
            c = b = 0
            for k in depths:
                if k > t or not context[tuple(w[t - k : t])]:
                    break
                c, b = context[tuple(w[t - k : t])], both[tuple(w[t - k : t]), w[t]]
            score += math.log10((b + MU * p[t]) / (c + MU) if c else p[t])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, p)), rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert ngram_scores(empty).count() == 0


def test_ngram_scores_longest_context(spark):
    """Contexts of all lengths, also between 4, 8, 12, 64 and 72: copies cut anywhere, nested and repeated passages, whole copies."""
    from palimpsest.llm.scoring import MU, ngram_scores

    r = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [list(r.choice(vocab, int(n))) for n in (30, 60, 90, 150, 150)]
    rows = [" ".join(b) for b in base] + ["a a a a a a a a a a a a b", "a a a a a a a a a a a a a a", "b a a a a a a b"]
    for _ in range(80):
        b = base[int(r.integers(0, len(base)))]
        i = int(r.integers(0, len(b) - 6))
        rows.append(" ".join([*r.choice(vocab, int(r.integers(0, 4))), *b[i : i + int(r.integers(5, len(b)))], *r.choice(vocab, int(r.integers(0, 4)))]))
        j = int(r.integers(1, len(b)))
        rows.append(" ".join([*b[:j], "cut", *b[int(r.integers(0, j)) :]]))
    texts = {i: (zlib.crc32(str(i).encode()) % 7 == 2, [*t.split(), None]) for i, t in enumerate(rows)}
    train = [w for held, w in texts.values() if not held]
    uni = collections.Counter(x for w in train for x in w)
    grams = collections.Counter(hash(tuple(w[i:j])) for w in train for i in range(len(w)) for j in range(i + 1, len(w) + 1))
    n, v, longest = sum(uni.values()), len(uni), set()
    got = ngram_scores(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").repartition(3)).collect()
    assert len(got) == len(rows) and any(held for held, _ in texts.values())
    for row in got:
        held, w = texts[row["doc_id"]]
        score = 0.0
        for t in range(len(w)):
            p = (uni[w[t]] + 1) / (n + v + 1)
            k = max((k for k in range(1, t + 1) if grams[hash(tuple(w[t - k : t]))]), default=0)
            longest |= {k} if held else set()
            score += math.log10((grams[hash(tuple(w[t - k : t + 1]))] + MU * p) / (grams[hash(tuple(w[t - k : t]))] + MU) if k else p)
        assert math.isclose(row["score"], score, rel_tol=1e-9), (row["doc_id"], held)
    assert longest >= {*range(0, 40), 65, 71, 73}


def test_prefixes_of_long_texts_are_asked_at_once():
    """A text's own prefixes take one step, not one for each length; prefixes of others are still found inside."""
    from palimpsest.llm import scoring as S

    r = np.random.default_rng(9)
    first, other = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (3000, 40))
    tokens = np.concatenate([first, other, first[:20], other])  # a second text: other; a third: the first 20 words, then other
    s = S.Stretches(tokens, np.array([3000, 40, 60]), np.zeros(3, bool), np.ones(3, bool))
    own = s.prefixes()
    asked = s.keys(own, s.room[own])
    width = 22
    row = S.bitmap_row(np.unique(asked), width, S.PROBES)
    bits, low = np.zeros(1 << (width - 3), np.uint8), int(np.frombuffer(row[2], "<i8")[0])
    bits[low : low + len(row[3])] = np.frombuffer(row[3], np.uint8)
    steps = list(s.asked(bits, 0, 0))
    assert len(steps) < 60
    got = dict(zip(*np.unique(np.concatenate(steps), return_counts=True)))
    assert all(got[k] == 1 for k in s.keys(np.arange(20, 3000), np.arange(21, 3001)))  # longer than 20 words only in the first
    assert all(got[k] == 2 for k in s.keys(np.arange(4, 20), np.arange(5, 21)))
    assert all(got[k] == 2 for k in s.keys(np.arange(3004, 3040), np.arange(5, 41)))  # at the second's start and inside the third


def test_prefixes_inside_texts_are_found_by_leaps():
    """Long prefixes within other texts take a few steps, not one for each length, and every length is counted."""
    from palimpsest.llm import scoring as S

    r = np.random.default_rng(10)
    first, other, more = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (3000, 7, 5))
    tokens = np.concatenate([first, other, first[:2345], more, first[:77]])
    s = S.Stretches(tokens, np.array([3000, len(tokens) - 3000]), np.zeros(2, bool), np.ones(2, bool))
    own = s.prefixes()
    width = 22
    row = S.bitmap_row(np.unique(s.keys(own, s.room[own])), width, S.PROBES)
    bits, low = np.zeros(1 << (width - 3), np.uint8), int(np.frombuffer(row[2], "<i8")[0])
    bits[low : low + len(row[3])] = np.frombuffer(row[3], np.uint8)
    steps = list(s.asked(bits, 0, 0))
    assert len(steps) < 60
    got = dict(zip(*np.unique(np.concatenate(steps), return_counts=True)))
    for a, e, n in ((5, 77, 3), (78, 2345, 2), (2346, 3000, 1)):
        assert all(got[k] == n for k in s.keys(np.arange(a - 1, e), np.arange(a, e + 1)))


def test_digit_rounds_read_what_queried_texts_share():
    """Training passages that only training texts repeat stay out of the digit rounds; prefixes still see them."""
    import pyarrow as pa

    from palimpsest.llm import scoring as S

    class Frame:
        def mapInArrow(self, fn, schema):
            return fn

    class Bits:
        def __init__(self, t, spans, width=20):
            at = np.concatenate([np.arange(a + 3, e) for a, e in spans])
            row = S.bitmap_row(np.unique(t.keys(at, S.WHOLE, S.WHOLE)), width)
            self.value, low = np.zeros(1 << (width - 3), np.uint8), int(np.frombuffer(row[2], "<i8")[0])
            self.value[low : low + len(row[3])] = np.frombuffer(row[3], np.uint8)

    repeated, shared = " ".join(f"r{i}" for i in range(40)), " ".join(f"s{i}" for i in range(30))
    texts = [f"{repeated} x {shared}", f"y {repeated}", f"z {shared}"]
    b = pa.RecordBatch.from_arrays([pa.array([7, 7, 7]), pa.array([False, False, True]), pa.array(texts)], names=["block", "held", "__text"])
    t = next(S.groups(b))[1]
    spans = [(0, 40), (41, 71)]
    rows = pa.Table.from_batches(list(S.reduced(Frame(), Bits(t, spans), Bits(t, spans[1:]))(iter([b])))).to_pylist()
    got = {r["use"]: (np.frombuffer(r["lengths"], "<i8").tolist(), np.frombuffer(r["held"], bool).tolist()) for r in rows}
    assert got == {0: ([40, 30, 40], [False] * 3), 1: ([30, 30], [False, True])}


def test_joined_hashes(monkeypatch):
    """Words are told apart as word_hashes does, text by text and whatever the lengths of words and texts."""
    from palimpsest.llm import hashing as H

    r = np.random.default_rng(4)
    texts = [b"", b" ", b"a", b"A a\x00 a\x00\x00 \x00", b"\t\nx\x0by\x0c z\r", "é É ß".encode(), b"\x1c\x1f\x85 \xa0b"]
    texts += [b" ".join(bytes(r.choice(list(b"abAB"), int(n))) for n in r.integers(1, 4, 300))]
    texts += [b" ".join(b"q" * n + b"z" * (n % 2) for n in range(1, 200)), b"W" * 5000, b"v" * 64 + b" " + b"v" * 65 + b" " + b"V" * 65]
    want = [H.word_hashes(x) for x in texts]
    for most in (H.JOINED, 64):
        monkeypatch.setattr(H, "JOINED", most)
        got, n = H.joined_hashes(texts)
        assert n.tolist() == list(map(len, want))
        pairs = set(zip(got.tolist(), np.concatenate(want).tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_answers_are_looked_up():
    from palimpsest.llm import scoring as S

    r = np.random.default_rng(6)
    for n in (0, 1, 2, 5000):
        key = np.unique(r.integers(0, 2**48, n).astype(np.uint64))
        key[: n // 2] >>= np.uint64(30)  # crowded at one end
        key = np.unique(key)
        known = S.Known([])
        known.of(3)
        known.set(key, np.arange(len(key)) + 1)
        asked = np.concatenate([key, key + np.uint64(1), r.integers(0, 2**48, 100).astype(np.uint64), np.array([0, 2**48 - 1], np.uint64)])
        have = dict(zip(key.tolist(), range(1, len(key) + 1)))
        assert known.look(asked, 9).tolist() == [have.get(k, 9) for k in asked.tolist()]


def test_stretches_leave_the_disk(spark):
    """What only the rounds read is deleted after them; their answers stay."""
    from pathlib import Path

    from palimpsest.llm.common import scratch_dir
    from palimpsest.llm.scoring import ngram_scores

    root = Path(scratch_dir(spark).removeprefix("file:")).parent
    before = set(root.rglob("*.parquet"))
    text = " ".join(f"w{i}" for i in range(50))
    out = ngram_scores(spark.createDataFrame([(i, f"{i} {text}") for i in range(30)], "doc_id int, text string"))
    new = {str(p.relative_to(root)) for p in set(root.rglob("*.parquet")) - before}
    assert any("/round/" in p for p in new) and not any("stretches" in p or "block=-1" in p or "block=-3" in p for p in new)
    assert out.count() == 30


def test_keys_leave_in_bounded_batches():
    """A pool's keys leave their task in batches of a bounded number of keys, with the counts of all of them."""
    from palimpsest.llm import scoring as S

    keys = np.random.default_rng(2).integers(0, 2**48, 1_500_000).astype(np.uint64)
    pools = S.Pools(64)
    list(pools.enter(7))
    pools.add(0, keys)
    pools.add(0, keys[:1000])
    batches = list(pools.flush(0))
    assert all(sum(b.column("n").to_pylist()) <= S.BATCH_KEYS + len(keys) // 32 for b in batches) and len(batches) > 2
    got = [[np.cumsum(S.unplanes(k, n, 6), dtype=np.uint64), S.unplanes(c, n, 4)] for b in batches for n, k, c in zip(*(b.column(x).to_pylist() for x in ("n", "keys", "counts")))]
    key, n = np.unique(np.concatenate([keys, keys[:1000]]), return_counts=True)
    assert (np.concatenate([k for k, _ in got]) == key).all() and (np.concatenate([c for _, c in got]) == n).all()


def test_workers_give_memory_back(spark):
    """A worker that peaked at over 300 MB of small pieces, with one left at the top, doesn't keep them; batches are bounded in bytes."""
    from palimpsest.llm.common import lean, small_batches

    def run(batches):
        import pyarrow as pa

        pieces = [bytearray(50_000) for _ in range(7000)]
        globals()["__top"] = [pieces[-1]]
        del pieces
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows)], names=["id"])

    def resident(batches):
        import pyarrow as pa

        for b in lean(run)(batches):
            pass
        mb = int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
        yield pa.RecordBatch.from_arrays([pa.array([mb])], names=["id"])

    small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) == 8 << 20
    assert spark.range(1).coalesce(1).mapInArrow(resident, "id bigint").first()[0] < 300


def test_language(spark, docs):
    from palimpsest.llm.langid import identify

    r = np.random.default_rng(1)
    sound = {"aa": "aeioubdg", "bb": "xyzqwkjv", "cc": "éàüölmnr"}
    rows = [(i, "".join(r.choice(list(s + "  "), 60)), lang) for i, (lang, s) in enumerate(list(sound.items()) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "aeiou", None)]
    got = {x["doc_id"]: x for x in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [d for d, t, lang in rows if d < 1000 and got[d]["held_out"]]
    assert len(held) > 20 and sum(got[d]["lang_pred"] == rows[d][2] for d in held) >= 0.98 * len(held)
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values()) and identify(docs[2]).count() == 0


def test_language_scores(spark):
    """Against a plain multinomial naive Bayes with dictionaries, at texts longer than a block too."""
    from palimpsest.llm import langid as L

    r = np.random.default_rng(9)
    sound = {"aa": "aeioubdgst", "bb": "aeixyzqwst", "cc": "éàüölmnrst"}
    text = lambda lang, n: "".join(r.choice(list(sound[lang] + "   "), n))
    rows = [(i, text(lang, int(r.integers(3, 40))), lang) for i, lang in enumerate(list(sound) * 40)]
    rows += [(500, text("bb", L.BLOCK + 1000), "bb"), (501, "½ ² Ⅷ 12", "aa"), (502, "ǅ", None), (503, "ªº", None), (504, text("aa", 50), None), (505, text("aa", 50), None)]
    grams = lambda t: [int(x) for part in L.ngram_buckets(t) for x in part]
    plain = lambda t: collections.Counter(t[i : i + n] for t in [f" {t.lower()} "] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    assert len(grams("abc dé")) == sum(plain("abc dé").values()) and len(grams(rows[120][1])) == sum(plain(rows[120][1]).values())
    train = [(t, lang) for d, t, lang in rows if lang and zlib.crc32(str(d).encode()) % 5 and any(c.isalpha() for c in t)]
    counts = {lang: collections.Counter(g for t, x in train if x == lang for g in grams(t)) for lang in sorted(sound)}
    docs = collections.Counter(x for _, x in train)
    got = {x["doc_id"]: x for x in L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        log = {x: math.log(docs[x] / len(train)) + sum(math.log((c[g] + 1) / (sum(c.values()) + L.BUCKETS)) for g in grams(t)) for x, c in counts.items()}
        best = max(sorted(log), key=log.get)
        assert got[d]["lang_pred"] == best and math.isclose(got[d]["score"], 1 / sum(math.exp(v - log[best]) for v in log.values()), rel_tol=1e-3)
    assert got[501]["lang_pred"] == "und" and got[502]["lang_pred"] != "und"


def test_too_many_labels_raise(spark, monkeypatch):
    from palimpsest.llm import langid

    monkeypatch.setattr(langid, "MAX_LABELS", 3)
    with pytest.raises(Exception, match="labels"):
        langid.fit(spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(5)], "text string, lang string"))


def test_solver_and_components_raise(spark, monkeypatch):
    from palimpsest.llm import mixing
    from palimpsest.llm.common import components

    monkeypatch.setattr(mixing, "SOLVER_NODES", 1)
    df = spark.createDataFrame([(1, "a b", ["x"]), (2, "c", ["x", "y"])], "doc_id int, text string, source array<string>")
    with pytest.raises(ValueError, match="patterns"):
        mixing.Mix(df)
    single = mixing.Mix(spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id int, text string, source string"))
    assert single.decisions().count() == 2  # beyond the solver's size the targets themselves
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(64)], "a int, b int"), 1)


def test_hot_signatures_and_heavy_buckets(spark, docs, monkeypatch):
    """Blocks of holders and grids of buckets give what plain tasks give."""
    from palimpsest.llm import jaccard as J

    r = np.random.default_rng(8)
    base = [f"w{i}" for i in r.integers(0, 900, 120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in r.integers(0, 120, 3):
            w[at] = f"c{r.integers(0, 99)}"
        rows.append((i, " ".join(w), "x", "y"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string, a string")
    plain = sorted(map(tuple, J.jaccard_groups(df).collect()))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t, *_ in rows)]
    assert [x[2] for x in plain] == [sum(100 * len(a & b) >= 70 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    table = [J.index(df, "text", 3, 0, J.Threshold(70, 100), np.zeros(0, np.uint64), 1).toArrow()]
    whole = J.distinct_pairs(J.matches(J.Threshold(70, 100), 1)(table[0]))
    monkeypatch.setattr(J, "HOLDERS", 8)
    cut = J.matches(J.Threshold(70, 100), 1)(table[0])
    blocks = cut.filter(cut.column("left").is_valid()).select(["left", "right"])
    assert blocks.num_rows > 3
    parts = [b.column("data").to_pylist() for b in J.expand(J.Threshold(70, 100), 1)(iter(blocks.to_batches()))]
    rest = cut.column("data").drop_null().to_pylist() + [x for p in parts for x in p]
    again = J.distinct_pairs(J.pa.table({"data": J.pa.array(rest, J.pa.binary())}))
    assert sorted(zip(*whole.to_pydict().values())) == sorted(zip(*again.to_pydict().values()))
    monkeypatch.setattr(J, "SET_BYTES", 2000)
    monkeypatch.setattr(J, "CELL_PAIRS", 50)
    assert sorted(map(tuple, J.jaccard_groups(df).collect())) == plain


def test_families_of_near_copies(spark, monkeypatch):
    """Pairs of a family aren't met in the index, and blocks of families give every link once."""
    from palimpsest.llm import jaccard as J

    r = np.random.default_rng(12)
    rows = []
    for f, n in enumerate((70, 40, 9)):
        base = [f"w{i}" for i in r.integers(0, 900, 150)]
        for _ in range(n):
            w = list(base)
            for at in r.integers(0, 150, int(r.integers(0, 12))):
                w[at] = f"c{r.integers(0, 999)}"
            rows.append((len(rows), " ".join(w if r.random() < 0.8 else w[: int(r.integers(90, 150))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    near = [[j for j, b in enumerate(sets) if j != i and 100 * len(a & b) >= 70 * len(a | b)] for i, a in enumerate(sets)]
    assert 1000 < sum(map(len, near)) < 70 * 69 + 40 * 39 + 9 * 8
    monkeypatch.setattr(J, "FAMILY", 4)
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    assert [x["n_similar"] for x in sorted(J.jaccard_groups(df).collect())] == [len(x) for x in near]
    monkeypatch.setattr(J, "BROADCAST_IDS", 80)  # sets of the smaller families go by the index
    assert [x["n_similar"] for x in sorted(J.jaccard_groups(df).collect())] == [len(x) for x in near]
    hashed = [J.shingle_set(t.encode()) for _, t in rows]
    for common, listed in ((1, 100), (64, 4_000_000), (10**9, 50)):
        monkeypatch.setattr(J, "COMMON", common)
        monkeypatch.setattr(J, "LISTED", listed)
        assert (J.common(hashed[:60], hashed[50:]) == [[len(a & b) for b in sets[50:]] for a in sets[:60]]).all()
    index = J.index(df, "text", 3, 0, J.Threshold(70, 100), np.zeros(0, np.uint64), 1).toArrow()
    nodes = {J.set_ids(h, 0)[0] >> 23: J.family_keys(h) for h in hashed}
    families = J.Families(np.array(list(nodes), np.uint64), np.stack(list(nodes.values())))

    class Known:
        value = families

    for holders in (2048, 8):
        monkeypatch.setattr(J, "HOLDERS", holders)
        met = J.matches(J.Threshold(70, 100), 1, Known)(index)
        data = met.column("data").drop_null().to_pylist()
        for b in J.expand(J.Threshold(70, 100), 1, Known)(iter(met.filter(met.column("left").is_valid()).select(["left", "right"]).to_batches())):
            data += b.column("data").to_pylist()
        pairs = J.distinct_pairs(J.pa.table({"data": J.pa.array(data, J.pa.binary())}))
        a, b = (families.of(pairs.column(c).to_numpy().view(np.uint64)) for c in "ab")
        assert len(a) and not families.shared(a, b).any()


def test_bitmap_filter():
    """The filter of many pairs at once keeps what single comparisons keep."""
    from palimpsest.llm import jaccard as J

    r, t = np.random.default_rng(6), J.Threshold(70, 100)
    sets = [np.unique(r.integers(0, 2**64, int(n), dtype=np.uint64)) for n in r.integers(1, 700, 60)]
    sets += [x[r.random(len(x)) < 0.9] for x in sets if len(x) > 20]
    pairs = list(itertools.combinations(range(len(sets)), 2))
    full = [(i, None, len(x), J.parity(x), 5) for i, x in enumerate(sets)]
    rows = list(zip(*full + [(a, b, None, None, 5) for a, b in pairs]))
    kinds = (J.pa.int64(), J.pa.int64(), J.pa.int64(), J.pa.binary(), J.pa.int32())
    got = J.filtered(t)(J.pa.table({k: J.pa.array(x, kind) for k, x, kind in zip(("a", "b", "n", "bits", "bucket"), rows, kinds)}))
    near = [(a, b) for a, b in pairs if J.unequal(J.parity(sets[a]), J.parity(sets[b])) <= t.differing(len(sets[a]) + len(sets[b]))]
    assert list(zip(got.column("a").to_pylist(), got.column("b").to_pylist())) == near and 20 < len(near) < len(pairs)


def test_empty_neighbours_are_no_signatures():
    """Sets of one shingle a segment share no signature of an empty segment."""
    from palimpsest.llm import jaccard as J

    r = np.random.default_rng(5)
    seen: set = set()
    for _ in range(200):
        h = np.unique(r.integers(0, 2**64, 6, dtype=np.uint64))
        own = {int(x) for s, _ in J.signatures(h, np.ones(len(h), bool), J.Threshold(70, 100)) for x in s}
        assert not own & seen
        seen |= own


def ids_of(t):
    from palimpsest.llm.tokens import load

    return np.array(load(TOKENIZER).encode(t or "", add_special_tokens=False).ids, "<u4")


def test_binary_round_trip(spark, docs, tmp_path):
    from palimpsest.llm.binary import best_fit_decreasing, pack_rows, read_binary, segments, write_binary

    rows, df, empty = docs
    packed = pack_rows(df, TOKENIZER, row=64)
    parts = collections.defaultdict(dict)
    for r in packed.collect():
        ids, pos = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == 64 and r["cu_seqlens"][0] == 0
        for d, s, n, a, e in zip(r["docs"], r["starts"], r["doc_tokens"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (pos[a:e] == np.arange(e - a)).all() and s not in parts[d]
            parts[d][s] = ids[a:e]
    for d, t, *_ in rows:
        assert (np.concatenate([parts[d][s] for s in sorted(parts[d])]) == ids_of(t)).all()
    assert segments(packed).where("not resets").count() == 0 and segments(packed).count() == sum(map(len, parts.values()))
    written = write_binary(packed, str(tmp_path / "bin"), 64, 2).collect()
    total = sum(np.fromfile(tmp_path / "bin" / f"ids-{r['part']}.u16", "<u2").size for r in written)
    assert total == 64 * sum(r["rows"] for r in written) == 64 * packed.count()
    back = read_binary(spark.createDataFrame(written), str(tmp_path / "bin"), packed, 64, 2)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, packed.collect()))
    assert pack_rows(empty, TOKENIZER).count() == 0
    lengths = [int(x) for x in np.random.default_rng(2).integers(0, 65, 500)]
    bins = best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 64 for b in bins)
    plain: list[list[int]] = []  # the fullest row that still holds the item, by looking at all
    for n in sorted(lengths, reverse=True):
        fits = [b for b in plain if sum(b) + n <= 64]
        if fits:
            max(fits, key=sum).append(n)
        else:
            plain.append([n])
    assert sorted(sum(lengths[i] for i in b) for b in bins) == sorted(map(sum, plain))  # rows of equal capacity are alike


@pytest.mark.parametrize("pool", [1 << 22, 300])
def test_packing(docs, pool):
    from palimpsest.llm.packing import pack

    rows, df, empty = docs
    tiers = (256, 128, 64, 32)
    got = pack(df, TOKENIZER, tiers=tiers, pool=pool, step=512, with_ids=True).collect()
    parts, seqs = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        parts[r["doc_id"]][r["start"]] = bytes(r["ids"])
        seqs[r["sequence_id"]][r["offset"]] = r["length"]
    for d, t, *_ in rows:
        whole = ids_of(t).tobytes() + (2).to_bytes(4, "little")
        assert b"".join(parts[d][s] for s in sorted(parts[d])) == whole
    padded = 0
    for s in seqs.values():
        at = 0
        for o in sorted(s):
            assert o == at
            at += s[o]
        assert at <= 256
        padded += at & (at - 1) > 0
    assert padded <= 3 and pack(empty, TOKENIZER).count() == 0


def test_components(spark):
    from palimpsest.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
