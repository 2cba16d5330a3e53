import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, chosen_path, decontamination, line_dedup, lm, mixing, pii, token_counts, topk, toxicity
from quire.llm.common import shared_folder, word_hash, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, token long, key string"


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "one two three", "a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i j k", long, "x" * 50_000, "line a b c d\nline a b c d\n\nother line here now", "mail a@b.co ip 1.2.3.4 card 4111 1111 1111 1111 phone +1 (555) 123-4567", "née Ünïcode　wide"]
    rows = [(i, t, None, [None, "s1", "s2"][i % 3], None, 7, "x", 1, "k") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "a b c d e f g h i j", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_words():
    texts = ["a b", "", None, " ", "The the\tTHE\x0bé", "x" * 3_000_000 + " y"]
    w = words(pa.array(texts))
    assert [w.hashes[a:b].tolist() for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)] == [[word_hash(x.lower()) for x in WORD.findall(t or "")] for t in texts]


# --- 1


def luhn(d):
    return sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            out += [(m.start(), no, m.end(), kind)] if ok else []
    return sorted(out)


def test_pii_base(spark, docs, none):
    odd = ["a@b.c%d@e.f", "x@y@z.w", "a@@b@c.d", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "+1 (555) 123-4567 +12", "é 4111111111111111 ñ@a.b", "1.1" + ".1" * 3000, "9" * 20_000, "x" * 20_000 + "@", "a@" + "b." * 3000 + "c", "a@b.c_d@e.f_g@h.i", None, ""]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in d.collect()}
    got = pii.found(d).collect()
    assert len(got) == len(text)
    for r in got:
        b = base(text[r.doc_id])
        joined = ",".join(f"{k}:{x}:{y}" for x, _, y, k in b)
        assert hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256 and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in b) for k in KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined
    assert pii.found(none).count() == 0


def test_pii_disclosure(spark):
    """A nickname that stands only beside one address, in distinct texts, discloses it; common words don't."""
    told = [(i, f"text {i} says zorblax wrote from zed@mail.example the other day") for i in range(4)]
    other = [(100 + i, f"text {i} says somebody wrote the other day number{i}") for i in range(200)]
    d = spark.createDataFrame([*told, *other, (900, "only zorblax here")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(d, least=0.85).collect()}
    assert got[0].n_term >= 1 and "term:12:19" in got[0].spans.split(",") and got[900].spans == "term:5:12" and got[100].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitised(d, least=0.85).collect()}
    assert "zorblax" not in clean[900] and "[EMAIL]" in clean[0] and clean[100] == other[0][1]


def test_pii_rare_entity(spark):
    """A name beside an address that one text holds goes, by the production parameters; a rare word far from it and common words stay."""
    far = "the other day " * 10
    told = [(0, f"farword {far}Zorblax wrote from zed@mail.example the other day {far}endword")]
    other = [(100 + i, f"somebody wrote from the other day the mail example unique{i}") for i in range(200)]
    d = spark.createDataFrame([*told, *other, (900, "the other day zed wrote")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(d).collect()}
    assert got[0].n_term == 1 and got[900].n_term == 0 and got[100].n_term == 0  # zed is in 2 of 202 texts: D = 0.87
    clean = {r.doc_id: r.text for r in pii.sanitised(d).collect()}
    assert clean[0] == f"farword {far} wrote from [EMAIL] the other day {far}endword" and clean[100] == other[0][1]
    got = {r.doc_id: r.spans for r in pii.found(d, least=0.85).collect()}
    assert got[900] == "term:14:17"


def test_pii_beside(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "é", " ", "-", "9", "x" * rng.randrange(9)]) for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    rows = []
    for t in texts:
        a = rng.randrange(len(t) + 1)
        rows.append((t, a, rng.randrange(a, len(t) + 1)))
    d = spark.createDataFrame(rows, "text string, start long, end long")
    for r in d.withColumn("got", pii._beside(F.col("text"), F.col("start"), F.col("end"), 5)).collect():
        assert set(r.got) == {m[0] for m in re.finditer(r"[^\W_]+", r.text) if m.start() >= r.start - 5 and m.end() <= r.end + 5}


# --- 2


def test_token_lengths_equal_whole_encoding(docs):
    encode = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY)).encode_ordinary
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["", None, " ", "  ", "a  b", "\n\na", "a \n", "a b  c", "a　 b", "it's  'll x'", "x\n \ny", "\tq", "a\x0b\x0cb", "   lead", "trail   ", "a \nb"]
    assert token_counts.token_lengths(pa.array(texts), encode).tolist() == [len(encode(t or "")) for t in texts]


def test_histogram(spark, edge, none):
    h = token_counts.length_histogram(token_counts.encoded_lengths(edge)).toPandas().sort_values("n_tokens")
    encode = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY)).encode_ordinary
    n = sorted(len(encode(r[1] or "")) for r in edge_rows())
    assert h.n_docs.sum() == len(n)
    for r in h.itertuples():
        assert r.docs_longer == sum(x > r.n_tokens for x in n) and r.tokens_longer == sum(x for x in n if x > r.n_tokens) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    frame = spark.createDataFrame(h)
    assert {r.context: r.truncated_tokens for r in token_counts.context_totals(frame, [3, 100]).collect()} == {c: sum(min(x, c) for x in n) for c in (3, 100)}
    assert token_counts.length_quantile(frame, 0.5).first()[0] == n[math.ceil(len(n) / 2) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(none)).count() == 0


# --- 3


def tiled(a, b, least):
    """Greedy string tiling, word by word."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n > best:
                best, found = n, [(i, j)]
            elif n == best and n >= least:
                found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = [False] * best
                free_b[j : j + best] = [False] * best
                out.append((best, i, j))


def test_tiling_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randrange(3) for _ in range(rng.randrange(25))], [rng.randrange(3) for _ in range(rng.randrange(12))]
        hashed = lambda x: np.array([word_hash(str(v)) for v in x], np.uint64)
        assert sum(t[0] for t in decontamination.tile(hashed(a), hashed(b), 2)) == sum(t[0] for t in tiled(a, b, 2))


def test_decontamination(spark, edge, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    reordered = "Eta, theta: iota kappa lambda mu! -- noise -- ALPHA beta gamma delta epsilon zeta"
    rows = [(1, f"before {reordered} after"), (2, "alpha beta gamma delta epsilon and nothing more"), (3, "one TINY item."), (4, "tinyitem"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {(1, 1), (3, 4)} and got[1, 1].n_tiles == 2 and got[1, 1].coverage == 1.0
    blocks = decontamination.contaminated(d, bench, block_bytes=10)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(got)
    assert sorted(r.doc_id for r in decontamination.decontaminate(d, bench).collect()) == [2, 4, 5]
    assert decontamination.decontaminate(edge, bench).columns == edge.columns and decontamination.decontaminate(edge, bench).count() == edge.count()
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(edge, bench.where("false")).count() == 0


# --- 4


def test_mixing(spark, docs, edge, none, duck, same):
    same(mixing.taken(docs).toPandas(), duck.execute(mixing.SQL).fetchdf())
    got = mixing.taken(edge).toPandas()
    assert len(got) == edge.count() and (got.taken <= 2 * got["size"]).all() and not got.source_size.isna().any()
    m = mixing.mixture(edge)
    assert m.agg(F.sum("mix_words")).first()[0] == got.taken.sum() and set(edge.columns) < set(m.columns)
    assert mixing.taken(none).count() == 0


def test_hypergeometric(spark):
    tree = mixing.splitting_tree(spark.createDataFrame([(0, 600), (1, 100), (2, 77)], "rank long, blocks long"), 8).toPandas()
    assert tree.groupby("rank").blocks.sum().tolist() == [600, 100, 77] and tree.groupby("shard").blocks.sum().between(96, 98).all()
    k = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(15), mixing._uniform(1, F.col("id"))).alias("k")).toPandas().k
    assert abs(k.mean() - 6) < 0.15 and abs(k.var() - 15 * 0.4 * 0.6 * 35 / 49) < 0.3


# --- 5


def test_escapes():
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "s", ">", "/", "\\", "[", "INST", "]", "<|", "|>", "turn", "end", "<s>", "</s>", "\n"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and not any(c in chat.escape(s) for c in chat.CONTROL)
        assert chat.read_window(chat.format_window([(s, s)], (False, 0, 0, 1))[0]) == [(True, s, s)]


def test_chat(spark, sf):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said), (-8, 0, "system", "be kind"), (-8, 1, None, None), *[(-8, i, ["user", "assistant"][i % 2], "word " * 40) for i in range(2, 30)], (None, None, "assistant", "x"), (-9, 1, "assistant", "tie"), (-9, 1, "assistant", "tie")], "conv_id long, turn long, role string, text string")
    conv = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    for budget, history in ((512, 128), (100, 60), (1, 0)):
        got = {r.conv_id: r for r in chat.read_back(chat.formatted(conv, budget, history)).collect()}
        frame = conv.toPandas()
        for key, q in frame.groupby("conv_id", dropna=False):
            key = None if key != key else key
            turns = sorted(((r if isinstance(r, str) else "", t if isinstance(t, str) else "", n) for r, t, n in zip(q.role, q.text, q.turn, strict=True)), key=lambda x: (x[2], x[0], x[1]))
            loss = "".join(t for r, t, _ in turns if r == "assistant")
            r = got[key]
            assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, _ in turns).encode()).hexdigest()
            assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    encode = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY)).encode_ordinary
    turns = [("system", "be [INST] kind"), ("user", "word " * 40)]
    assert [chat.turn_tokens(encode, *t) for t in turns] == [len(encode("be [\\INST] kind")) + len(encode("system")) + 3, len(encode("word " * 40)) + len(encode("user")) + 3]
    # 10 a turn, budget 35 and history 12: the system turn and one turn of history leave room for one new turn
    assert chat.windows([10] * 5, True, 35, 12) == [(False, 0, 0, 3), (True, 2, 3, 4), (True, 3, 4, 5)]
    assert chat.windows([10, 90, 10], False, 35, 12) == [(False, 0, 0, 1), (False, 1, 1, 2), (False, 2, 2, 3)] and chat.windows([], False) == []
    assert chat.formatted(conv.where("false")).count() == 0
    clash = conv.withColumn("turns", F.lit(1)).withColumn("windows", F.lit("x")).withColumn("a.b", F.lit(2))
    assert chat.formatted(clash).count() == chat.formatted(conv).count()
    windows = chat.formatted(conv.where("conv_id = -8"), 100, 60).first().windows
    assert len(windows) > 5 and all(chat.read_window(w.text)[0][1] == "system" for w in windows)


# --- 6


def test_topk(spark, sf, duck, same):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    same(topk.nearest_of_every(e).toPandas(), duck.execute(topk.SQL).fetchdf())
    odd = spark.createDataFrame([(50, None), (100, [1.0, None]), (150, [float("nan")]), (200, []), (250, [0.5] * 64), (251, [0.5] * 64), (251, [0.5] * 64), (252, [0.25, -1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    got = topk.nearest_of_every(odd).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 250) == [(250, 1, 251, 64 * 128**2), (250, 2, 251, 64 * 128**2), (250, 3, 200, 0), (250, 4, 252, 64 * 128 - 256 * 128)]
    assert {r.query_id for r in got} == {200, 250} and topk.nearest_of_every(odd.where("false")).count() == 0


# --- 7


def test_toxicity(spark, edge, none):
    rng = random.Random(5)
    bad = ["vile", "nasty", "awful"]
    rows = []
    for i in range(600):
        grade = i % 3
        text = [f"word{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))] + rng.sample(bad, grade)
        rng.shuffle(text)
        rows.append((i, " ".join(text), grade))
    d = spark.createDataFrame(rows, "doc_id long, text string, grade long")
    model = toxicity.trained(d.where("doc_id < 450").select("doc_id", "text"), d.select("doc_id", F.col("grade").alias("toxic")))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.scored(d.where("doc_id >= 450"), model).toPandas().set_index("doc_id")
    assert np.mean([got.severity[i] == g for i, _, g in rows[450:]]) > 0.95
    assert toxicity.without_toxic(edge, model).count() == edge.count() and toxicity.without_toxic(edge, model).columns == edge.columns
    empty = toxicity.trained(none, d.select("doc_id", F.col("grade").alias("toxic")).where("false"))
    assert toxicity.scored(edge, empty).where("expected_severity = 0").count() == edge.count()


def test_toxicity_held_out(spark):
    """Labels that the fit has not seen: two thirds of the labelled documents train, the rest is scored."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.trained(docs, labels.where("doc_id % 3 != 0"))
    unseen = labels.where("doc_id % 3 = 0 and toxic is not null")
    got = toxicity.scored(docs, model).join(unseen, "doc_id").select("toxic", (F.col("p_above_least") >= toxicity.THRESHOLD).alias("said")).toPandas()
    toxic = got[got.toxic == 1]
    assert len(toxic) > 100 and toxic.said.mean() > 0.8 and got[got.toxic == 0].said.mean() < 0.005


def test_toxicity_odd_labels(spark):
    """Null grades and ids count for nothing, the largest of several labels counts, repeated rows are scored each."""
    d = spark.createDataFrame([(i, "vile thing " * (i % 2) + f"word{i % 5} text") for i in range(60)] + [(1, "vile thing word1 text"), (None, "vile thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (3, None), (None, 1), (999, 1)], "doc_id long, toxic long")
    got = toxicity.scored(d, toxicity.trained(d, labels)).collect()
    assert len(got) == 62 and all((r.severity == 1) == (r.doc_id is None or r.doc_id % 2 == 1) for r in got)


# --- 8


def test_lm(spark, docs, edge, none):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    for d, known in ((docs.select("doc_id", "text"), 500), (edge, 1 << 19)):
        frame = d.select("doc_id", "text").collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(x for r in frame if not held(r.doc_id) for x in [*WORD.findall(low(r.text)), None])
        n, v = sum(c.values()), len(c)
        expected = Counter()
        for r in frame:
            t = [*WORD.findall(low(r.text)), None]
            expected[r.doc_id, len(t), sum(c[x] > 0 for x in t), held(r.doc_id), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 5)] += 1
        got = lm.scored(d, known=known).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
        assert all(r.score < 0 for r in got)
    assert lm.scored(none).count() == 0


def test_lm_probabilities_add_up():
    keys = np.sort(np.random.default_rng(1).integers(1, 2**62, 3000).astype(np.uint64))
    counts = np.random.default_rng(2).integers(1, 50, 3000)
    bins = np.arange(3000) % lm.MEMBERS
    sums = np.bincount(bins, counts + 1, lm.MEMBERS)
    c = lm.Counts(int(counts.sum()), 3000, keys, counts, bins, sums)
    p1 = np.exp(c.bias_1 - np.log(np.exp(c.bias_1.astype(float)).sum()))
    assert abs(p1.sum() - 1) < 1e-5
    tail = c.slot < 0
    for b in range(lm.MEMBERS):  # the bin's words and one unseen word share its mass
        assert abs((c.counts[tail & (bins[np.argsort(keys)] == b)] + 1).sum() + 1 - c.bin_mass[b]) < 1e-6


def test_lm_score_against_brute_force(spark):
    """The model's score of every text is the sum of its tokens' log probabilities, each worked out by hand from counts and weights."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(1500)]
    d = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(1500)], k=60)) + " unseen%d" % i) for i in range(120)], "doc_id long, text string").repartition(1).cache()
    training = d.where(~lm.held_out(F.col("doc_id")))
    c = lm.gathered_counts(lm.token_counts(training).cache())
    w = lm.trained(training, spark.sparkContext.broadcast(c))
    assert w.rows == lm.LEAST_ROWS and np.abs(w.flat).max() > 0
    soft = lambda x: np.exp(x.astype(float) - x.max()) / np.exp(x.astype(float) - x.max()).sum()
    got = {r.doc_id: r.score for r in lm.scored(d).collect()}
    for r in d.collect()[:30]:
        t = lm.Tokens(pa.array([r.text]))
        group, member = c.symbols(t, *c.look_up(t.hash))
        first, second = w.rows_of(t, slice(0, len(t)), group)
        score = 0.0
        for i, (g, m) in enumerate(zip(group, member, strict=True)):
            p1 = soft(c.bias_1 + sum(w.first[f[i]] for f in first))
            p2 = soft(c.bias_2[g] + sum(w.second[f[i]] for f in second))
            at = np.flatnonzero(c.keys == t.hash[i])
            share = (c.counts[at[0]] + 1 if len(at) else 1) / c.bin_mass[m] if g == lm.CLASSES else 1
            assert abs(p1.sum() - 1) < 1e-9 and abs(p2.sum() - 1) < 1e-9
            score += math.log10(p1[g] * p2[m] * share)
        assert abs(score - got[r.doc_id]) < 0.02
    # the shares of a bin's words, and of one unseen word, add up to 1
    tail = c.slot < 0
    assert tail.sum() > 100 and lm.rows_for(10**10) > lm.rows_for(10**9) > lm.rows_for(10**8) == lm.LEAST_ROWS and lm.rows_for(10**15) == lm.MOST_ROWS


def test_lm_gains_on_held_out_texts(spark):
    got = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score") - F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[1] > 0.05


# --- 9


def links_of(texts):
    sets = {}
    for t in texts:
        w = tuple(WORD.findall((t or "").lower()))
        if w:
            sets[w] = {w[i : i + 5] for i in range(max(1, len(w) - 4))}
    out = Counter()
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            out[a] += 1
            out[b] += 1
    return out


def test_chosen_path(spark, edge, none):
    rng = random.Random(9)
    base_words = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.004 * (i % 7) else f"x{rng.randrange(99)}" for w in base_words)) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{rng.randrange(10_000)}" for _ in range(50))) for i in range(40)] + [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "a b"), (205, "A  b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    expected = links_of(t for _, t in rows)
    for small in (256, 4):  # small buckets make the paths split and the groups fall into units
        got = {r.doc_id: r for r in chosen_path.similar_groups(d, small=small).collect()}
        assert {i: got[i].n_links for i, _ in rows} == {i: expected[tuple(WORD.findall((t or "").lower()))] for i, t in rows}
    assert got[200].copy_id == 3 and got[201].class_id == got[3].class_id == 0 and got[205].copy_id == 204 and got[203].class_id == 203
    kept = chosen_path.one_of_each(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 8, 9}
    assert [r.doc_id for r in kept.collect()].count(5) == 1 and chosen_path.similar_groups(none).count() == 0


def test_chosen_path_recall(spark):
    """All pairs of a whole table by brute force: nine of ten links are found at least, none that is not there; the tables of the way go."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(12)
    rows += [(5000 + k, " ".join(w if rng.random() > 0.02 else f"q{rng.randrange(99)}" for w in rows[k][1].split())) for k in range(0, 400, 4)]
    expected = links_of(t for _, t in rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = {r.doc_id: r.n_links for r in chosen_path.similar_groups(d, small=16).collect()}
    want = {i: expected[tuple(WORD.findall((t or "").lower()))] for i, t in rows}
    assert sum(want.values()) > 100 and all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())
    assert len(set(folder.iterdir()) - before) == 1


# --- 10


def removed(rows, t=0.8):
    seen, out = [], set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if s and any(len(s & x) >= t * len(s | x) - 1e-9 for x in seen):
                out.add((i, n))
            if s:
                seen.append(s)
    return out


def test_line_dedup(spark, docs, edge, none):
    rng = random.Random(4)
    line = [f"w{i}" for i in range(30)]
    rows = [(i, "\n".join(" ".join(w if rng.random() > 0.05 else f"z{rng.randrange(50)}" for w in line) for _ in range(3)) + f"\nown line number {i} of this text\nthe the of") for i in range(40)]
    rows += [(r.doc_id + 1000, r.text) for r in docs.limit(60).collect()] + [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "a b c d e"), (5004, "a b c d"), (5005, "d c b a a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, n) for r in line_dedup.removed_lines(d).collect() for n in r.removed}
    assert got == removed(rows)
    text = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(d).collect()}
    assert text[5004] == "" and text[5003] == "a b c d e" and text[5000] is None and text[39].count("\n") <= 4
    out = line_dedup.without_repeated_lines(edge)
    assert out.columns == edge.columns and out.count() == edge.count() and line_dedup.removed_lines(none).count() == 0


def test_line_dedup_shared_ids(spark):
    """Different texts under one id, or none: only their own repeated lines go, also at the same line number."""
    for no in (None, 7):
        rows = [(no, "P\nQ"), (no, "R\nP"), (no, "S\nQ"), (no, "T"), (no, "T")]
        out = [r.text.split("\n") for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert Counter(x for lines in out for x in lines if x) == Counter({"P": 1, "Q": 1, "R": 1, "S": 1, "T": 2})


def test_line_dedup_other_similarity(spark):
    """Below 0.8 small sets are compared too; crowded groups are settled first; both as by brute force."""
    rng = random.Random(8)
    rows = [(1, "a b"), (2, "a b c"), (3, "x y z"), (4, "x y")]
    rows += [(10 + i, "\n".join(" ".join(rng.sample("the of and to in is it on".split(), rng.randrange(1, 7))) for _ in range(3))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for t, crowd in ((0.6, 256), (0.6, 2), (0.8, 2), (1.0, 256)):
        got = {(r.doc_id, r.line_no) for r in line_dedup.marked_lines(d, t, crowd).collect()}
        assert got == removed(rows, t)


def test_line_dedup_long_lines(spark):
    """Near copies around the length from which sketches have 128 cells; the ranks of tokens are plain longs, never null."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(line_dedup.LONG + 6)]
    rows = [(i, "\n".join(" ".join(w if rng.random() > 0.06 else f"z{rng.randrange(99)}" for w in words[: len(words) - rng.randrange(14)]) for _ in range(4))) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.line_no) for r in line_dedup.marked_lines(d, crowd=10_000).collect()} == removed(rows)
    codes = d.select(line_dedup.ranks(F.col("text"), [0] * (1 << line_dedup.BIN_BITS)).alias("codes"))
    assert not codes.schema["codes"].dataType.containsNull


# --- the pipeline


CLASH = "doc_id long, text string, lang string, source string, n_chars long, extra string, _hash long, gone_id string, mix_shard int, `a.b` string, _bit long, state boolean, text_hash string"


def clash_rows():
    """Repeated ids with different texts, null ids, copies, repeated rows, empty texts, and columns with clashing names."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    own = [f"{prose(12)}\n{prose(9)}\n{prose(30)}" for _ in range(30)]
    near = own[3].replace(own[3].split()[-1], "changed").replace("\n", " ")
    texts = [*enumerate(own), (5, own[4]), (None, own[6]), (None, own[7]), (None, prose(20)), (7, prose(40)), (7, prose(8) + "\n" + own[9].split("\n")[0]), (60, own[3].replace("\n", " ")), (61, near)]
    texts += [(62, None), (63, ""), (None, None), (62, None), (8, own[8]), (8, own[8]), (64, "the vile nasty thing " + prose(9)), (65, f"{prose(5)} vile {prose(5)}"), (66, prose(3) + " alpha beta gamma delta epsilon zeta eta theta " + prose(4))]
    return [(i, t, None, [None, "s1", "s2"][n % 3], n, f"e{n}", n, "g", 5, f"dot{n}", 1, True, "h") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame(clash_rows(), CLASH).cache()


def kept_lines(rows):
    """(id, text) to the text that stays, by brute force: a line goes if one before it, by (id, hash of the text, number), is similar."""
    seen, out = [], {}
    for i, h, t in sorted({(r[0], h, r[1]) for r, h in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        stay = []
        for line in (t or "").split("\n"):
            s = frozenset(WORD.findall(line))
            if not s or not any(len(s & x) >= 0.8 * len(s | x) - 1e-9 for x in seen):
                stay.append(line)
            if s:
                seen.append(s)
        out[i, t] = None if t is None else "\n".join(stay)
    return out


def one_each(rows):
    """Numbers (n_chars) of groups of rows of which one stays, and of the rows that stay, by brute force; rows: (id, text, hash, number)."""
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in {tuple(WORD.findall((t or "").lower())) for _, t, _, _ in rows} if w}
    group = {w: {w} for w in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and group[a] is not group[b]:
            group[a] |= group[b]
            for w in group[b]:
                group[w] = group[a]
    least, out = {}, []
    for i, t, h, n in rows:
        w = tuple(WORD.findall((t or "").lower()))
        if not w:
            out.append({n})
        else:
            least.setdefault(id(group[w]), []).append(((i is None, i or 0, h), n))
    return out + [{n for k, n in x if k == min(x)[0]} for x in least.values()]


def test_row_identity(spark, clash):
    """No row or line is lost that brute force keeps, whatever ids and columns are."""
    rows = [(tuple(r), r.th) for r in clash.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    out = line_dedup.without_repeated_lines(clash)
    expected = kept_lines(rows)
    assert out.columns == clash.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter((r[0], expected[r[0], r[1]], *r[2:13]) for r, _ in rows)
    hashes = {r.n_chars: r.th for r in clash.select("n_chars", F.xxhash64("text").alias("th")).collect()}
    groups = one_each([(r[0], r[1], hashes[r[4]], r[4]) for r, _ in rows])
    kept = chosen_path.one_of_each(clash)
    stayed = [r.n_chars for r in kept.collect()]
    assert kept.columns == clash.columns and len(stayed) == len(groups) and all(len(g & set(stayed)) == 1 for g in groups)
    clean = pii.sanitised(clash)
    assert clean.columns == clash.columns and clean.count() == len(rows) and {r.extra for r in clean.collect()} == {r[5] for r, _ in rows}
    mix = mixing.mixture(clash)
    assert mix.columns == [*clash.columns, "_mix_shard", "mix_round", "mix_words", "mix_place"] and {r.mix_shard for r in mix.collect()} == {5}
    dealt = mixing.shards(clash).toPandas()
    assert dealt.words.sum() == mix.agg(F.sum("mix_words")).first()[0] and dealt.documents.sum() == mix.count()


def test_pipeline_stages(spark, clash, tmp_path):
    """Each stage on its own input, against brute force; the input has the hard cases of clash_rows."""
    import corpus_pipeline as p

    rng = random.Random(2)
    train = [(1000 + i, " ".join([f"t{rng.randrange(300)}" for _ in range(20)] + ["vile"] * (i % 2))) for i in range(200)]
    docs = clash.unionByName(spark.createDataFrame(train, "doc_id long, text string"), allowMissingColumns=True)
    spark.createDataFrame([(i, i % 2) for i, _ in train] + [(None, 1), (3, None)], "doc_id long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Alpha beta, gamma delta epsilon zeta eta theta"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    number = lambda d: Counter(r.n_chars for r in d.where("n_chars is not null").collect())
    for name, stage in p.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = stage(spark, docs, str(tmp_path)).cache()
        rows = docs.where("n_chars is not null").collect()
        if name == "toxicity":
            assert number(out) == Counter(r.n_chars for r in rows if "vile" not in (r.text or "").split())
            assert {r.doc_id for r in out.where("doc_id >= 1000").collect()} == {i for i, t in train if "vile" not in t.split()}
        elif name == "line_dedup":
            every = [((r.doc_id, r.text), r.th) for r in docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
            expected = kept_lines(every)
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, expected[i, t]) for (i, t), _ in every)
        elif name == "near_copies":
            groups = one_each([(r.doc_id, r.text, r.th, k) for k, r in enumerate(docs.withColumn("th", F.xxhash64("text")).collect())])
            assert out.count() == len(groups)
        elif name == "decontamination":
            gone = [r for r in rows if sum(t[0] for t in tiled(WORD.findall((r.text or "").lower()), "alpha beta gamma delta epsilon zeta eta theta".split(), 5)) >= 0.6 * 8]
            assert len(gone) == 1 and number(out) == number(docs) - Counter(r.n_chars for r in gone)
        else:
            words_of = lambda t: len(WORD.findall(t or ""))
            drawn = Counter()
            for r in out.collect():
                drawn[r.doc_id, r.text] += r.mix_words if "_mix_shard" not in out.columns else r["mix_words"]
            taken = Counter()
            for r, t in zip(*(x.collect() for x in (docs.orderBy("doc_id", "text"), mixing.taken(docs).orderBy("doc_id"))), strict=True):
                taken[t.doc_id] += t.taken
            assert sum(drawn.values()) == sum(taken.values()) and all(n <= 2 * words_of(t) * sum(r.doc_id == i and r.text == t for r in docs.collect()) for (i, t), n in drawn.items())
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "mixing"]
    out = p.run(spark, sf)
    assert set(d.columns) < set(out.columns) and out.count() > 0
    assert out.select("doc_id").distinct().count() <= d.count()
