"""The learned operators against plain loops over characters, words and clauses."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF_DIR

from tallyframe.llm import lang_id, quality, toxicity

MASK, FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15


def language_grams(text):
    """Buckets of the one, two and three letters in a row of a text whose words stand between single blanks."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return []
    s = " " + " ".join(words) + " "
    codes = [ord(c) for c in s if c != " "]
    codes += [(ord(a) * 1_000_003 + ord(b)) ^ (1 << 60) for a, b in zip(s, s[1:])]
    codes += [((ord(a) * 1_000_003 + ord(b)) * 1_000_003 + ord(c)) ^ (1 << 61) for a, b, c in zip(s, s[1:], s[2:])]
    return [(code * FACTOR & MASK) >> 50 for code in codes]


class PlainLanguages:
    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            counts.setdefault(lang, Counter()).update(language_grams(text))
        self.names = sorted(counts)
        total = {lang: sum(c.values()) + 0.5 * lang_id.BUCKETS for lang, c in counts.items()}
        self.share = {lang: lambda b, c=c, t=total[lang]: (c[b] + 0.5) / t for lang, c in counts.items()}
        self.codes = lang_id.codewords(len(self.names)).tolist()
        bits = range(len(self.codes[0]))
        least = []
        for bit in bits:
            margins = []
            for i, lang in enumerate(self.names):
                side = 1 if self.codes[i][bit] else -1
                margins.append(side * sum(self.share[lang](b) * self.weight(b, bit) for b in range(lang_id.BUCKETS)))
            least.append(max(0.05, min(margins)))
        self.bit_weights = [x * len(least) / sum(least) for x in least]

    def weight(self, bucket, bit):
        sides = ([], [])
        for i, lang in enumerate(self.names):
            sides[self.codes[i][bit]].append(self.share[lang](bucket))
        return math.log(sum(sides[1]) / len(sides[1])) - math.log(sum(sides[0]) / len(sides[0]))

    def predict(self, text):
        grams = language_grams(text)
        if not grams:
            return "und", 0.0
        margins = [sum(self.weight(g, bit) for g in grams) / math.sqrt(len(grams)) for bit in range(len(self.bit_weights))]
        loss = [
            sum(w * math.log1p(math.exp(-(m if code[bit] else -m))) for bit, (m, w) in enumerate(zip(margins, self.bit_weights)))
            for code in self.codes
        ]
        odds = [math.exp(min(loss) - x) for x in loss]
        best = odds.index(max(odds))
        return self.names[best], odds[best] / sum(odds)


def test_languages_equal_plain_loops(spark):
    rows = [(r["text"][:400], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(40).collect() if r["lang"]]
    model = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    plain = PlainLanguages(rows)
    for text in [*[t[50:90] for t, _ in rows[:12]], "Zwölf Boxkämpfer", "", None, "123 !", "é"]:
        name, score, _ = model.predict(text)
        want, plain_score = plain.predict(text)
        assert name == want and score == pytest.approx(plain_score, rel=1e-6)


def quality_grams(text):
    """Buckets of word shapes and words, one word or run of words after the other."""
    words = (text or "").split()
    shapes, names = [], []
    for i, word in enumerate(words):
        marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        runs = [c for j, c in enumerate(marks) if j == 0 or marks[j - 1] != c]
        code = 2
        for c in runs:
            code = (code * 1_000_003 + ord(c)) & 0xFFFFFFFFFFFF
        shapes.append(1 if i and words[i - 1] == word else code)
        names.append(quality._Shapes()[word][1])
    out = set()
    for i in range(len(words)):
        rolled = shapes[i]
        out.add((rolled * FACTOR & MASK) >> 50)
        for n in (2, 3):
            if i + n <= len(words):
                rolled = (rolled * FACTOR & MASK) ^ shapes[i + n - 1]
                out.add(((rolled + (n << 50)) * FACTOR & MASK) >> 50)
        out.add(((names[i] * FACTOR & MASK) >> 50) + quality.BUCKETS)
        if i + 1 < len(words):
            pair = ((names[i] * 1_000_003 & MASK) ^ names[i + 1]) + (1 << 50)
            out.add(((pair & MASK) * FACTOR & MASK) >> 50 | quality.BUCKETS)
    return out


def test_quality_features_equal_plain_loops(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(30).collect()]
    for text in [*texts, None, "", " \n", "a", "a a a B b! 12x", "x" * 300 + "9!?;Z"]:
        assert set(quality.shape_ngrams(text, quality._Shapes()).tolist()) == quality_grams(text)


def test_support_vectors_reach_the_least_loss():
    """Dual coordinate descent of the classifier against many more rounds of a plain one."""
    rng = random.Random(2)
    samples = [np.array(sorted(rng.sample(range(40), 8) if y else rng.sample(range(15, 60), 8)), np.int32) for y in (0, 1) * 20]
    labels = [0, 1] * 20
    model = quality.fit_rows(samples, labels)
    counts = {c: [1] * 60 for c in (0, 1)}
    for g, y in zip(samples, labels):
        for b in g:
            counts[y][b] += 1
    ratio = [math.log(counts[1][b] / 21) - math.log(counts[0][b] / 21) for b in range(60)]
    rows = [{int(b): ratio[b] / math.sqrt(len(g)) for b in g} for g in samples]

    def loss(w, bias):
        margins = [(1 if y else -1) * (sum(w[b] * x for b, x in row.items()) + bias) for row, y in zip(rows, labels)]
        return 0.5 * (sum(x * x for x in w) + bias * bias) + quality.COST * sum(max(0.0, 1 - m) for m in margins)

    w, bias, alpha = [0.0] * 60, 0.0, [0.0] * 40
    for _ in range(3000):
        for i, (row, y) in enumerate(zip(rows, labels)):
            sign = 1 if y else -1
            gradient = sign * (sum(w[b] * x for b, x in row.items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(x * x for x in row.values()) + 1), 0.0), quality.COST)
            for b, x in row.items():
                w[b] += (new - alpha[i]) * sign * x
            bias += (new - alpha[i]) * sign
            alpha[i] = new
    fitted = [float(model.weights[b] / ratio[b]) if ratio[b] else 0.0 for b in range(60)]
    assert loss(fitted, model.bias) <= 1.02 * loss(w, bias)


def plain_clauses(model, tokens):
    """Weights of the clauses of a list of words and full stops, by the rules one after the other."""
    out, total, found, aimed, armed, told, left = [], 0.0, False, False, False, False, 0
    for token in [*tokens, "."]:
        kind, scale = model.lexicon.get(token, ("other" if token.isalpha() else "end", 1.0))
        gained = 0.0
        if kind == "end":
            if total > 0:
                out.append(round(total, 9))
            total, found, aimed, armed, told, left = 0.0, False, False, False, False, 0
            continue
        negated, left = left > 0, 3 if kind == "negation" else max(0, left - 1)
        weight = None
        if kind == "insult":
            weight = 0.4 if negated else 0.6 if told else 1.0
        elif kind == "threat" and not negated and not told:
            armed = True
        elif kind == "report":
            told = True
        elif kind == "target":
            if armed:
                armed, weight = False, 1.0
                gained += 0.3 if aimed and not found else 0.0
                aimed, found = True, True
                total += (weight + gained) * scale
                continue
            if not aimed and found:
                gained = 0.3
            aimed = True
        if weight is not None:
            gained = weight + (0.3 if aimed and not found else 0.0)
            found = True
        total += gained * scale
    return out


def test_composed_grammar_equals_plain_rules():
    model = toxicity.ToxicityModel(toxicity.base_lexicon(), toxicity.UNTRAINED)
    rng = random.Random(6)
    kinds = [toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, ["house", "water", "tree"], ["."]]
    some = 0
    for _ in range(3000):
        tokens = [rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 14))]
        got = [round(w, 9) for w, _ in model.clauses(" ".join(tokens))]
        assert got == plain_clauses(model, tokens), tokens
        some += bool(got)
    assert some > 1000


def test_recurrent_states_equal_plain_steps():
    """Both directions over padded pages against one step after the other over each page alone."""
    from tallyframe.llm import html_extract as h

    rng = np.random.default_rng(4)
    w, bias = rng.normal(0, 0.2, (h.INPUT + h.HIDDEN, 4 * h.HIDDEN)).astype(np.float32), rng.normal(0, 0.2, 4 * h.HIDDEN).astype(np.float32)
    lengths = [5, 1, 9]
    flat = rng.normal(0, 1, (sum(lengths), h.INPUT)).astype(np.float32)
    padded = h._padded(flat, lengths)
    forward, _ = h._lstm(padded, w, bias, False)
    backward = h._reversed(h._lstm(h._reversed(padded, lengths), w, bias, False)[0], lengths)

    def plain(inputs):
        state, cell, out = np.zeros(h.HIDDEN), np.zeros(h.HIDDEN), []
        for x in inputs:
            gates = np.concatenate((x, state)) @ w + bias
            i, f, o = (1 / (1 + np.exp(-gates[k * h.HIDDEN : (k + 1) * h.HIDDEN])) for k in range(3))
            cell = f * cell + i * np.tanh(gates[3 * h.HIDDEN :])
            state = o * np.tanh(cell)
            out.append(state)
        return np.array(out)

    at = 0
    for page, n in enumerate(lengths):
        rows = flat[at : at + n]
        at += n
        assert np.allclose(forward[page, :n], plain(rows), atol=1e-5)
        assert np.allclose(backward[page, :n], plain(rows[::-1])[::-1], atol=1e-5)


def test_what_pages_leave_in_memory_is_bounded():
    from tallyframe.llm.html_blocks import blocks
    from tallyframe.llm.html_extract import Vectoriser

    remembers, fresh = Vectoriser(), Vectoriser()
    remembers.LIMIT = 50
    pages = [blocks("".join(f'<div class="c{i}-{j} {"n" * j}"><p>word{i} {"w" * 60}{j} text</p></div>' for j in range(30))) for i in range(5)]
    for page in pages + pages[:1]:
        a, b = remembers([page]), fresh([page])
        assert a.path_ids.tolist() == b.path_ids.tolist() and a.word_ids.tolist() == b.word_ids.tolist()
        assert remembers.path_tokens <= 50 and len(remembers.words) <= 50
