from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from driftwright.llm import toxicity as tox

from .helpers import awkward, awkward_rows, empty


def brute_kernel(x, y, order=tox.ORDER, decay=tox.DECAY):
    """Sum over pairs of equal subsequences of decay to the lengths that they span."""
    from itertools import combinations

    def spans(s):
        found = {}
        for at in combinations(range(len(s)), order):
            key = "".join(s[i] for i in at)
            found[key] = found.get(key, 0.0) + decay ** (at[-1] - at[0] + 1)
        return found

    a, b = spans(x), spans(y)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_matches_its_definition():
    def code(s, width):
        return np.array([[ord(c) - 96 for c in s] + [0] * (width - len(s))], dtype=np.uint8)

    for x, y in [("idiot", "idiot"), ("idxiot", "idiot"), ("clown", "crown"), ("abc", "abcabc"), ("ab", "abc")]:
        assert np.isclose(tox.gap_kernel(code(x, 8), code(y, 8))[0], brute_kernel(x, y))


def test_common_length_matches_dynamic_programming():
    def slow(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    kernel = tox.KernelMap(["worthless"])
    for word in ["worthless", "wxorthles", "thole", "zzz", "sselhtrow", "w"]:
        codes = kernel._codes([word], 12)
        assert tox.common_length(codes, kernel.tables[0], 9)[0] == slow(word, "worthless")


def model():
    texts, labels = [], []
    rng = np.random.RandomState(3)
    for i in range(200):
        words = [f"{''.join(rng.choice(list('aeionrst'), 5))}" for _ in range(30)]
        if i % 4 == 0:
            words[rng.randint(30)] = ["gloopy", "frumpwit", "snarkel"][i % 3]
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return tox.ToxicModel(texts, labels), texts, np.array(labels)


def test_learns_marks_and_tolerates_inserted_letters():
    m, texts, labels = model()
    assert {w[:4] for w in m.kernel.landmarks} >= {"gloo", "frum", "snar"}
    scores = m.scores(texts)
    assert ((scores >= 0.5) == (labels == 1)).mean() > 0.98
    clean, insult, spelt, slipped, dotted = m.scores(["a calm line about rest", "you gloopy one", "you g l o o p y one", "a frump-wit he is", "such a s.n.a.r.k.e.l here"])
    assert clean < 0.5 < min(insult, spelt, slipped, dotted)
    assert m.scores(["you snarxkel"])[0] > max(0.5, 3 * clean) and m.scores([None, ""])[0] == m.scores([""])[0] < 0.5


def test_long_words_are_read_to_the_end():
    m, _, _ = model()
    assert m.scores(["q" * 5000 + "gloopy"])[0] > 0.5 > m.scores(["q" * 5000])[0]


def test_query_holds_out_and_separates(spark, sf):
    got = tox.op6_toxicity(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def separation(rows):
    order = rows["score"].rank().to_numpy()
    bad = rows["toxic"].to_numpy() == 1
    return (order[bad].mean() - (bad.sum() + 1) / 2) / (~bad).sum(), (rows["predicted"] == rows["toxic"]).mean()


def test_accuracy_of_a_fold_of_the_training_rows(spark):
    """Settings are judged on folds of the rows that may be learnt from, here remainder 1 held back from training."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = tox.score_documents(docs, labels.filter(fold > 1)).join(labels.filter(fold == 1).select("doc_id", "toxic"), "doc_id").toPandas()
    auc, accuracy = separation(rows)
    assert auc > 0.93 and accuracy > 0.95


def test_awkward_rows_and_labels(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (6, 7), (7, 0)], "doc_id long, toxic int")
    got = tox.score_documents(awkward(spark), labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in got)
    none = tox.score_documents(awkward(spark), labels.filter(F.lit(False))).collect()
    assert {r["score"] for r in none} == {0.0}
    assert tox.score_documents(empty(spark), labels).count() == 0
    kept = tox.drop_toxic(awkward(spark), labels.filter(F.lit(False)))
    assert kept.columns == awkward(spark).columns and kept.count() == len(awkward_rows())


def test_damaged_short_insults_have_lower_values():
    kernel = tox.KernelMap(["scum", "idiot", "worthless"])
    for k, word, forms in [(0, "scum", ["scxum", "youscum", "bigfatscum", "scm"]), (1, "idiot", ["idxiot", "bigfatidiot", "idot", "idxot"]), (2, "worthless", ["wrthless", "worxthless", "bigworthless"])]:
        assert kernel([word])[0, k] > 0.999
        for form in forms:
            assert tox.FLOOR <= kernel([form])[0, k] < (1.0001 if form == "bigworthless" else 0.999), form
    assert not kernel(["um", "dot", "table", "less"]).any()


def insulted(insults, seed, n=240):
    rng = np.random.RandomState(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("aeionrst"), 5)) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randint(30)] = insults[i // 4 % len(insults)]
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return texts, labels, " ".join("".join(rng.choice(list("aeionrst"), 5)) for _ in range(12))


def test_damaged_insults_in_fresh_documents():
    """Whole, with a letter slipped in or left out, masked and glued: all on the toxic side of a clean text, by far."""
    texts, labels, fresh = insulted(["glup", "frumk", "zwabby", "snarkel"], 5)
    m = tox.ToxicModel(texts, labels)
    clean = m.scores([fresh])[0]
    forms = ["glup", "glxup", "glaup", "gl*p", "youglup", "qqglupqq", "frumk", "frxumk", "bigfatfrumk", "fr*mk", "frmk", "zwabby", "zw*bby", "snarkel", "snarel", "snrkel", "snarxkel"]
    scores = dict(zip(forms, m.scores([f"{fresh} {form} {fresh}" for form in forms]), strict=True))
    assert clean < 0.1 and min(scores[w] for w in ("glup", "frumk", "zwabby", "snarkel")) > 0.5
    for form, score in scores.items():
        assert score > max(0.15, 5 * clean), (form, score)


def slow_value(word, landmark):
    """Best normalised kernel value of a marked word's windows, by listing subsequences."""
    own = ("^" if len(landmark.strip("$")) <= tox.ANCHORED else "") + landmark
    word, best = f"^{word}$", 0.0

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for width in range(len(own) - 1, len(own) + tox.SLACK + 1):
        for at in range(len(word) - width + 1):
            part = word[at : at + width]
            if common(part, own) >= len(own) - 1:
                best = max(best, brute_kernel(part, own) / np.sqrt(brute_kernel(part, part) * brute_kernel(own, own)))
    return best if best >= tox.FLOOR else 0.0


def test_scores_match_brute_force():
    """Every step after the fit by plain loops: words, kernel values, sentences, margins, evidence and curve."""
    texts, labels, fresh = insulted(["glup", "frumk", "zwabby"], 8, 80)
    m = tox.ToxicModel(texts, labels)
    count = len(m.kernel.landmarks)
    probes = [*texts[:6], f"{fresh}. You glxup! {fresh}\nfr-umk and Z W A B B Y. zw4bby", "", "glup glup. glup", "a.b,c"]
    for text, score in zip(probes, m.scores(probes), strict=True):
        spelt = ["".join(c for c in run if c.isalpha()) for run in tox.SPELT.findall(text)]
        first = second = 0.0
        for words in [*[s.split() for s in tox.BREAK.split(text)], *[[w] for w in spelt]]:
            best = [max((slow_value(tox.clean_word(w), x) for w in words), default=0.0) for x in m.kernel.landmarks]
            if any(best):
                margin = sum(v * a + v**tox.SHARP * b for v, a, b in zip(best, m.alpha[:count], m.alpha[count:], strict=True)) + m.bias
                beyond = max(margin - m.bias / 2, 0.0)
                first, second = first + beyond**2, second + beyond
        z = m.curve[0] * np.log1p(first) + m.curve[1] * np.log1p(second) + m.curve[2]
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_training_takes_two_thousand_documents_a_class():
    import inspect

    for f in (tox.train, tox.score_documents, tox.drop_toxic):
        assert inspect.signature(f).parameters["max_docs"].default == 2000
