"""Phrases, fill-in-middle and language ID against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import fill_middle, language_id, phrases

DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash", "clash") for i, t, lang in rows], DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11


def brute_phrases(rows, least, longest=5, covered=100, top=2000):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    f, n, out = {}, Counter(), []
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    own = f.setdefault(lang or "und", Counter())
                    own[w[i : i + k]] += 1
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def some_texts(seed=4):
    r = random.Random(seed)
    words = ["the", "of", "river", "River", "heron", "stone", "é", "日本", "a", "a", "x y"]
    line = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "!\n", "? ", ":x;"]) for _ in range(n))
    rows = [(i, line(r.randint(0, 60)), r.choice(["en", "en", "fr", None])) for i in range(120)]
    rows += [(200 + i, "grey heron stood in water. " * 9, "en") for i in range(3)] + [(200, "grey heron stood in water. " * 9, "en")] * 2
    return rows + [(300, None, "en"), (301, "", "fr"), (302, " \t,.", None), (None, "the river of stone", "en"), (303, "a a a a a a a", "fr"), (304, "the river " * 4000, "de"), (305, "\x0b\x0c\r.;", "en")]


@pytest.mark.parametrize("options", [{"least": 8}, {"least": 3, "longest": 4, "top": 25, "phrases": 7}, {"least": 5, "phrases": 4, "scans": 2}, {"least": 6, "covered": 60}])
def test_phrases_equal_brute_force(spark, options):
    """With one automaton, with many of them, and with the counts shuffled."""
    rows = some_texts()
    got = sorted(tuple(x) for x in phrases.mine(frame(spark, rows), **options).collect())
    want = brute_phrases(rows, options["least"], options.get("longest", 5), options.get("covered", 100), options.get("top", 2000))
    assert got == want and len(want) > 30


def test_steps_of_long_texts(spark, monkeypatch):
    rows = some_texts(5)
    held = [b for _, t, _ in rows for b in [(t or "").encode()]]
    monkeypatch.setattr(phrases, "_STEP_BYTES", 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(held)), pa.array(held, pa.binary())], ["lang", "text"])
    whole = [t for own in phrases._steps(iter([batch])) for t in own["en"]]
    assert b"".join(whole) == b"".join(t.translate(phrases._NORMAL) for t in held) and len(whole) > len(held)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """Where all counters are set every run of frequent words is a candidate."""
    monkeypatch.setattr(phrases, "sketch", lambda *a, **k: np.full(2 * phrases.ROW // 8, 255, np.uint8))
    rows = some_texts(6)
    assert sorted(tuple(x) for x in phrases.mine(frame(spark, rows), least=8).collect()) == brute_phrases(rows, 8)


def test_phrases_of_nothing(spark):
    assert phrases.mine(empty(spark)).count() == 0
    assert phrases.mine(frame(spark, [(1, "one two", "en"), (2, None, None)])).count() == 0
    with pytest.raises(ValueError):
        phrases.mine(empty(spark), least=0).count()


# --- 12


def brute_fim(i, text):
    t = text or ""
    n = len(t)
    x = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if i is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ab é日😀\n<PSM>́") for _ in range(r.randint(0, 40))), "en") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "en"), (None, "abc", "en"), (1002, "x<M>y", "en"), (1003, "é😀x" * 300_000, "en"), (7, rows[7][1], "en"), (-5, "negative", "en"), (1004, "one", "en")]
    made = fill_middle.transform(frame(spark, rows))
    got = [(*tuple(x)[:6], x.back) for x in made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()]
    assert Counter(got) == Counter((*brute_fim(i, t), t or "") for i, t, _ in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(empty(spark)).count() == 0


def test_other_units_and_markers(spark):
    rows = [(i, f"one two\nthree  é{i} five\n\nsix " * (i % 5), "en") for i in range(60)]
    for unit, pattern in (("word", r"\A[^ \n]+|[ \n]+[^ \n]*"), ("line", r"[^\n]*\n|[^\n]+")):
        made = fill_middle.transform(frame(spark, rows), unit=unit, rate=100, salt="z", markers=("[p.", "[s*", "[m|"))
        for x in made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), ("[p.", "[s*", "[m|"))).collect():
            text = rows[x.doc_id][1]
            units = re.findall(pattern, text)
            assert x.back == text and x.n == len(units) and (x.form == "plain") == (text == "")
            if text:
                ends = {len("".join(units[:k])) for k in range(len(units) + 1)}
                assert x.prefix_chars in ends and x.prefix_chars + x.middle_chars in ends


def test_index_in_small_chunks(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(fill_middle, "_CHUNK", 5)
    for _ in range(400):
        t = "".join(r.choice("ab é\n😀 ß\t") for _ in range(r.randint(0, 50)))
        for unit, units in (("char", list(t)), ("word", re.findall(r"\A[^ \n\t]+|[ \n\t]+[^ \n\t]*", t)), ("line", re.findall(r"[^\n]*\n|[^\n]+", t))):
            index = fill_middle.Index(t.encode(), unit, r.choice([1, 2, 3, 1024]))
            assert index.n == len(units) and index.chars == len(t)
            for k in range(len(units) + 1):
                own = "".join(units[:k])
                assert index.locate(k) == (len(own.encode()), len(own))
    with pytest.raises(ValueError):
        fill_middle.Index(b"", "page")


# --- 13

SOUNDS = {"en": ("the of and to in is that it was", "th er on an re he in ed nd"), "de": ("der die und das ist ein zu nicht", "en er ch ei sch ung au ie"), "es": ("el la de que y los se en", "os as ción do ar es que lla")}


def prose(r, lang, n):
    small, parts = (x.split() for x in SOUNDS[lang])
    return " ".join(r.choice(small) if r.random() < 0.4 else "".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n))


def test_languages_and_mixtures(spark):
    r = random.Random(3)
    rows = [(i, prose(r, lang := r.choice(list(SOUNDS)), r.randint(8, 60)), lang) for i in range(400)]
    model = language_id.fit(frame(spark, rows))
    assert model.langs == ("de", "en", "es")
    got = {x.doc_id: x for x in language_id.predict(frame(spark, rows), model).collect()}
    held = [(x, lang) for i, _, lang in rows for x in [got[i]] if x.held_out]
    assert len(held) > 90 and sum(x.lang_pred == lang for x, lang in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 and abs(sum(y.share for y in x.languages) - 1) < 1e-6 for x in got.values())
    assert sum(len(x.languages) == 1 for x in got.values()) >= 0.95 * len(rows)
    mixed = [(1000 + i, f"{prose(r, 'en', 100)} {prose(r, 'de', 50)}", None) for i in range(20)]
    for x in language_id.predict(frame(spark, mixed), model).collect():
        assert x.lang_pred == "en" and [y.lang for y in x.languages] == ["en", "de"] and abs(x.languages[0].share - 2 / 3) < 0.12


def test_mixtures_equal_a_plain_search():
    """The best set of all sets, by plain expectation-maximisation, has the penalised likelihood that the chosen one has."""
    from itertools import combinations

    r = np.random.default_rng(4)
    for _ in range(25):
        n = int(r.integers(1, 40))
        likely = r.normal(0, 1, (3, n)).astype(np.float32)
        lead = r.integers(0, 3)
        likely[lead] += 2
        if r.random() < 0.5:
            likely[(lead + 1) % 3, n // 2 :] += 6
        full, chosen = language_id.mixtures(likely, np.array([0]))

        def worth(langs):
            p, odds = np.full(len(langs), 1 / len(langs)), np.exp(likely[list(langs)].astype(float))
            for _ in range(300):
                part = odds * p[:, None]
                p = (part / part.sum(0)).mean(1)
            return np.log((odds * p[:, None]).sum(0)).sum() - len(langs) * language_id.PENALTY * np.log(n + 1)

        own = tuple(np.flatnonzero(chosen[:, 0]))
        best = max(worth(s) for k in (1, 2, 3) for s in combinations(range(3), k))
        assert worth(own) >= best - 0.15 and abs(full[:, 0].sum() - 1) < 1e-6


def test_language_of_odd_texts(spark):
    r = random.Random(5)
    rows = [(i, prose(r, lang := r.choice(["en", "de"]), 20), lang) for i in range(60)]
    model = language_id.fit(frame(spark, rows))
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34 !?\n", "de"), (None, "the of and", "en"), (103, "日本語", "en"), (104, prose(r, "de", 60_000), None), (105, "a" * 300_000, "en"), (106, "und", None), (106, "und", None), (107, "\U0001f600 İ", "en")]
    got = Counter((x.doc_id, x.lang_pred) for x in language_id.predict(frame(spark, odd), model).collect())
    assert got[100, "und"] == got[101, "und"] == got[102, "und"] == 1 and got[104, "de"] == 1 and got[106, "de"] == 2 and got[103, "de"] + got[103, "en"] == 1
    assert {x.score for x in language_id.predict(frame(spark, odd[:3]), model).collect()} == {0.0}
    nothing = language_id.fit(empty(spark))
    assert nothing.langs == () and {x.lang_pred for x in language_id.predict(frame(spark, odd), nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0
    unlabelled = language_id.fit(frame(spark, [(1, "text", None), (None, "text", "en"), (2, None, "en")]))
    assert unlabelled.langs == ()


def test_steps_of_long_texts_do_not_matter(monkeypatch):
    r = random.Random(6)
    model = language_id.Model(("a", "b"), np.random.default_rng(0).normal(-5, 1, (2, 3 << language_id.BITS)).astype(np.float32))
    text = prose(r, "es", 500)
    whole, _ = language_id.word_likelihoods(model, [text])
    parts = [language_id.word_likelihoods(model, [s])[0] for s in language_id._slices(text, 40)]
    assert "".join(language_id._slices(text, 40)) == text and np.allclose(np.concatenate(parts, axis=1), whole, atol=1e-4)
