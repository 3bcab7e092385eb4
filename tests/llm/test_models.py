"""Language, toxicity and packing: held-out accuracy, exact round trips, least cost."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.llm import language_id, packing, toxicity
from warpline.llm.queries import QUERIES, crc_fold, labelled_documents

SYLLABLES = {"xx": ["ba", "ku", "lo"], "yy": ["strem", "pfi", "zug"], "zz": ["ñe", "ción", "arr"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_held_out_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, invented(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randint(4, 60)), lang if i % 7 else None) for i in range(300)]
    truth = {i: next(k for k, v in SYLLABLES.items() if any(s in t for s in v)) for i, t, _ in rows}
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 34 !!", "zz"), (None, "strem pfi zug", None), (1003, "strem " * 300_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identify_languages(docs, crc_fold("doc_id", 4) != 2).collect()}
    right = [got[i].lang_pred == truth[i] for i in truth]
    assert sum(right) >= 0.97 * len(right)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"] and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify_languages(docs.limit(0), F.lit(True)).collect() == []
    assert {r.lang_pred for r in language_id.identify_languages(docs, F.lit(False)).collect()} == {"und"}


def plain_buckets(text):
    """Buckets of the n-grams of a text by definition: lower-cased letters, every run of others between or after them one space."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    found, top = set(), 32 - language_id.BUCKETS.bit_length() + 1
    for n in range(1, language_id.ORDER + 1):
        for i in range(len(out) - n + 1):
            h = ord(out[i])
            for k in range(2, n + 1):
                h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(out[i + k - 1]) * k) % 2**32
            found.add((h ^ (h >> 13)) * 0x9E3779B1 % 2**32 >> top)
    return found


@pytest.mark.parametrize("piece", [1, 2, 3, 8, 37, 1 << 20])
@pytest.mark.parametrize("text", ["Ab ćd 12 ef!gh " * 50, "a" + "1" * 50 + "b  --  c" + "." * 9, "  x", "12", "", "ΟΔΥΣ αβ、日本語 text", "a\nb" * 30])
def test_presence_does_not_depend_on_pieces(monkeypatch, piece, text):
    monkeypatch.setattr(language_id, "PIECE", piece)
    row = np.zeros(language_id.BUCKETS, np.float32)
    assert language_id.mark_presence(text, row) == any(c.isalpha() for c in text)
    if "Σ" not in text:  # a capital sigma is lowered by its place in the piece
        assert set(np.flatnonzero(row)) == plain_buckets(text) if any(c.isalpha() for c in text) else not row.any()


def test_kernel_ridge_against_its_definition():
    """Margins are those of one-versus-rest ridge regression on Nyström features, all kernels computed from plain sets."""
    rng = random.Random(11)
    languages = [lang for lang in sorted(SYLLABLES) for _ in range(12)]
    texts = [invented(rng, lang, rng.randint(3, 20)) for lang in languages]
    asked = [invented(rng, lang, 8) + " " + invented(rng, rng.choice(sorted(SYLLABLES)), 3) for lang in languages[::3]]
    model = language_id.fit(language_id.packed_presence(texts), languages, landmarks=9)
    sets = [plain_buckets(t) for t in texts]
    cosine = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [sets[12 * k + turn] for turn in range(3) for k in range(3)]
    k_nm, k_mm = (np.array([[cosine(a, b) for b in marks] for a in rows]) for rows in (sets, marks))
    y = np.array([[1.0 if lang == name else -1.0 for name in sorted(SYLLABLES)] for lang in languages])
    weights = np.linalg.solve(k_nm.T @ k_nm / 12 + language_id.RIDGE * k_mm + 1e-6 * np.eye(9), k_nm.T @ y / 12)
    names, scores = model.predict(asked)
    for text, name, score in zip(asked, names, scores, strict=True):
        margins = np.array([cosine(plain_buckets(text), m) for m in marks]) @ weights
        assert name == sorted(SYLLABLES)[int(np.argmax(margins))] and abs(score - min(1, max(0, (margins.max() + 1) / 2))) < 2e-3


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], {}
    for i in range(600):
        words = invented(rng, "xx", rng.randint(30, 200)).split()
        labels[i] = int(rng.random() < 0.3)
        for _ in range(4 * labels[i]):
            words[rng.randrange(len(words))] = "grut" + rng.choice(SYLLABLES["xx"])
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (None, "ba ku"), (902, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.where(crc_fold("doc_id", 5) != 0).join(spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), "doc_id")
    got = {r.doc_id: r._score for r in toxicity.toxicity_scores(docs, known, crc_fold("doc_id", 5) == 4).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i] >= 0.5) == bool(labels[i]) for i in held]
    assert len(got) == len(rows) and sum(right) >= 0.95 * len(right)
    assert all(0 <= s <= 1 for s in got.values())
    none = toxicity.toxicity_scores(docs, known.where("toxic = 0"), F.lit(False))
    assert {r._score for r in none.collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), known, F.lit(False)).collect() == []


class PlainKneserNey:
    """The models by their definition, recursively, from the words of the texts."""

    def __init__(self, rows, order=5, shared=2, discount=0.75):
        self.shared, self.discount = shared, discount
        occurrences = [Counter(), Counter()]
        for text, toxic in rows:
            for word in toxicity.words_of(text):
                padded = toxicity.PAD * (order - 1) + word + toxicity.END
                occurrences[toxic].update(padded[i : i + order] for i in range(len(word) + 1))
        self.own, self.pool = {order: occurrences}, {}
        for n in range(order - 1, 0, -1):
            self.own[n] = [Counter(g[1:] for g in up) for up in self.own[n + 1]]
            above = set(self.own[n + 1][0]) | set(self.own[n + 1][1])
            self.pool[n] = Counter(g[1:] for g in above)
        self.letters = sorted(self.pool[1])

    def p(self, toxic, context, x):
        if not context:
            return (self.pool[1][x] + 1) / (sum(self.pool[1].values()) + len(self.pool[1]) + 1)
        n = len(context) + 1
        counts = self.pool[n] if n <= self.shared else self.own[n][toxic]
        after = [c for g, c in counts.items() if g[:-1] == context and c > 0]
        low = self.p(toxic, context[1:], x)
        if not after:
            return low
        return max(counts[context + x] - self.discount, 0) / sum(after) + self.discount * len(after) / sum(after) * low

    def ratio(self, gram):
        return math.log(self.p(1, gram[:-1], gram[-1]) / self.p(0, gram[:-1], gram[-1]))


def test_kneser_ney_sums_to_one(spark):
    """Every context's probabilities, an unknown character's included, sum to one; the tables give their ratios, for seen and unseen n-grams."""
    rows = [("ab abc, bca. cab aab ab ab", 0), ("ab abc bca bca", 1), ("cc", 1)]
    plain = PlainKneserNey(rows)
    contexts = {g[:-1][-n:] for own in plain.own[5] for g in own for n in range(1, 5)} | {"zz", "abca"}
    for context in contexts:
        for toxic in (0, 1):
            assert abs(sum(plain.p(toxic, context, x) for x in [*plain.letters, "?"]) - 1) < 1e-12
    scratch = toxicity.Scratch(spark, "test")
    grams = scratch.save(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int").withColumn("held", F.lit(False))), "grams")
    assert {r.gram: (r.n0, r.n1) for r in grams.collect()} == {g: (plain.own[5][0][g], plain.own[5][1][g]) for g in set(plain.own[5][0]) | set(plain.own[5][1])}
    full = {c + x for c in contexts if len(c) == 4 for x in [*plain.letters, "?"]}
    got = {r.gram: r.own for r in toxicity.gram_evidence(spark.createDataFrame([(g,) for g in full], "gram string"), grams, scratch).collect()}
    assert len(got) == len(full) and all(abs(got[g] - plain.ratio(g)) < 1e-9 for g in full)


def test_no_gram_is_dropped(spark):
    """Words' evidence is what the models by their definition give, rare words included."""
    rng = random.Random(5)
    rows = [(invented(rng, "xx", 12) + f" w{i}q{i * 7}", int(i % 3 == 0)) for i in range(150)]
    scratch = toxicity.Scratch(spark, "test")
    grams = scratch.save(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int").withColumn("held", F.lit(False))), "grams")
    plain = PlainKneserNey(rows)
    words = sorted({w for t, _ in rows for w in toxicity.words_of(t)} | {"zzz", "bakuz", "é" * 9})
    padded = {w: "\x02" * 4 + w + "\x03" for w in words}
    expected = {w: sum(plain.ratio(p[i : i + 5]) for i in range(len(w) + 1)) for w, p in padded.items() if w in words[::9] + ["zzz", "bakuz", "é" * 9]}
    wanted = toxicity.different_grams(words)
    value = {r.gram: r.own for r in toxicity.gram_evidence(spark.createDataFrame([(g,) for g in wanted], "gram string"), grams, scratch).collect()}
    got = dict(zip(words, toxicity.word_sums(words, np.array([value[g] for g in wanted])), strict=True))
    assert len(value) == len(wanted) and all(abs(got[w] - x) < 1e-9 for w, x in expected.items())


def test_numbers_are_packed_without_loss():
    rng = np.random.default_rng(3)
    for own in ([], [0], [70_000, 3], list(rng.permutation(5000)[:700]), [2**31 - 1, 0]):
        assert toxicity.unpacked_numbers(toxicity.packed_numbers(np.array(own, dtype=np.int32))).tolist() == sorted(own)


def test_scores_compare_the_strongest_words(spark):
    """Scores rise with the ratio per character of the strongest different words, computed by definition."""
    rng = random.Random(8)
    rows = [(i, invented(rng, "xx", 20) + (" grutz morv" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = ["baku lo grutz", "baku", "", None, "grutz grutz morv", "lolo kuba baba kulo loba zz9", "morv " + "baku " * 50, "grutzlo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = PlainKneserNey([(t, y) for _, t, y in rows])

    def ratio(text):
        found = []
        for w in set(toxicity.words_of(text)):
            p = "\x02" * 4 + w + "\x03"
            found.append((sum(plain.ratio(p[i : i + 5]) for i in range(len(w) + 1)), len(w) + 1))
        top = sorted(found, key=lambda f: (-f[0], f[1]))[: toxicity.STRONGEST]
        return sum(f[0] for f in top) / sum(f[1] for f in top) if top else 0.0

    # Nothing calibrates, so the score is the logistic function of the ratio.
    got = {r.doc_id: r._score for r in toxicity.toxicity_scores(docs, labelled, F.lit(False)).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-ratio(t)))) < 1e-6 for i, t in enumerate(texts))


def test_labels_that_disagree_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(2, 1), (2, 0), (3, None), (None, 1), (900, 1), (5, 7)], "doc_id int, toxic int")
    got = {r.doc_id: r.toxic for r in labelled_documents(docs, labels).collect()}
    assert got == {i: 1 if i == 2 else i % 2 for i in range(30) if zlib.crc32(str(i).encode()) % 5}


def test_calibration_rows_are_counted(spark):
    """An expression that only calibration rows have is known to the model that scores, and unknown to the one that measures them."""
    rng = random.Random(6)
    rows = [(i, invented(rng, "xx", 40) + (" grutz" if i % 4 == 0 else ""), int(i % 4 == 0), False) for i in range(200)]
    rows += [(1000 + i, invented(rng, "xx", 40) + " vexpq" * (i % 2), i % 2, True) for i in range(100)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold boolean")
    docs = spark.createDataFrame([(1, invented(rng, "xx", 40) + " vexpq"), (2, invented(rng, "xx", 40))], "doc_id long, text string")
    scratch = toxicity.Scratch(spark, "test")
    grams = scratch.save(toxicity.gram_counts(labelled.withColumn("held", F.col("fold"))), "grams")
    found = {r.gram: (r.n0, r.n1, r.m0, r.m1) for r in grams.collect()}
    assert found["vexpq"] == (0, 50, 0, 0) and found["grutz"] == (0, 50, 0, 50)
    value = toxicity.gram_evidence(spark.createDataFrame([("vexpq",)], "gram string"), grams, scratch).first()
    assert value.own > 1 and value.apart == 0
    score = {r.doc_id: r._score for r in toxicity.toxicity_scores(docs, labelled, F.col("fold")).collect()}
    assert score[1] > score[2]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["It's 'sword' they're x's, \"quoted,\" end. É, ÀÉ. naïve! Ünï İstanbul ΟΔΥΣΣΕΥΣ. a\x1cb é,  z <|endoftext|> A<|ENDOFTEXT|> 3.5, 12% ab12,cd ... ,., x?!, n° ½, ª º µ ß, straße. ÿ;", "<|ENDOFTEXT|> HELLO,", "", "  ", "日本語。 テスト"]
    return odd + [" ".join(rng.choice(["Alpha", "beta,", "gamma.", "δ", "x1", "don't", "-", "No.", "é."]) for _ in range(rng.randint(0, 2500))) for _ in range(60)]


def test_words_alone_are_encoded_as_in_texts(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer()).encode_batch(texts, add_special_tokens=False)
    parts = packing.WordTokenizer(packing.default_tokenizer()).encode(texts)
    assert [e.ids for e in whole] == [p.tolist() for p in parts]


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, None), (7, "again"), (None, "no id here."), (6000, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, start string")
    pieces = packing.pack_documents(docs, partitions=2).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 4096
    unique = {i: t for i, t in rows if i not in (7, None)}
    for i, t in unique.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = [x for p in own for x in p.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert {p.doc_tokens for p in own} == {len(ids)} and [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    size = [sum(p.length for p in own) for own in sequences.values()]
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in size) < 0.05 * sum(size)
    digests = packing.pack_documents(docs, partitions=2, digest=True)
    assert "ids_crc32" in digests.columns
    assert packing.pack_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "date", "binary", "string"])
def test_ids_of_any_type_are_packed(spark, kind):
    made = {"date": "date_add(date'2020-01-01', cast(id as int))", "binary": "cast(cast(id as string) as binary)"}.get(kind, f"cast(id as {kind})")
    docs = spark.range(30).selectExpr(f"case when id = 3 then null else {made} end as doc_id", "repeat('word ', 20) as text")
    got = packing.pack_documents(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))


def test_cuts_cost_least(monkeypatch):
    monkeypatch.setattr(packing, "SHORTEST", 1)
    rng = random.Random(4)
    for _ in range(40):
        positions = [0]
        while len(positions) < 12:
            positions.append(positions[-1] + rng.randint(1, 16))
        penalties = [0] + [rng.choice([0, 3, 9]) for _ in positions[1:]]
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n

        def cost(cuts):
            return sum(penalties[j] + pad(positions[j] - positions[i]) for i, j in zip(cuts, cuts[1:], strict=False))

        best = [0.0] + [1e9] * (len(positions) - 1)
        for j in range(1, len(positions)):
            best[j] = min(best[i] + penalties[j] + pad(positions[j] - positions[i]) for i in range(j) if positions[j] - positions[i] <= 16)
        cuts = packing.choose_cuts(positions, penalties, 16)
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1 and cost(cuts) == best[-1]


def test_all_ten_are_registered():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 11)] == [1] * 10
