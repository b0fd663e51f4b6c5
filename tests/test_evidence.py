"""Evidence lint against scoring every sentence."""

import random
import re

from textloom.operators import evidence

EDGES = "edge_id int, source string, quote string, claim string"


def brute(edges, pages, threshold):
    out = []
    flat = lambda t: " ".join(t.lower().split())
    tokens = lambda t: list(dict.fromkeys(re.findall("[a-z0-9]+", (t or "").lower())))
    for i, source, quote, claim in dict.fromkeys(edges):
        body = pages.get(source)
        if body is None:
            out.append((i, source, "missing_source", None, None))
        elif quote and flat(quote) and flat(quote) in flat(body):
            out.append((i, source, "quoted", None, None))
        else:
            want, found = tokens(claim), []
            for place, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+", " ".join(body.split())) if x):
                n = len(set(want) & set(tokens(s)))
                if want and n / len(want) >= threshold - 1e-12 and n:
                    found.append((n, -place, s))
            best = max(found, default=None)
            out.append((i, source, "supported", round(best[0] / len(want), 4), best[2]) if best else (i, source, "unsupported", None, None))
    return sorted(out, key=str)


def test_equal_to_scoring_all_sentences(spark):
    r = random.Random(2)
    words = "heron river lake stone moon bird flies deep cold the of and in a".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    pages = {f"p{i}": " ".join(f"{text(r.randint(2, 9)).capitalize()}{r.choice('.!?')}" for _ in range(r.randint(1, 15))) for i in range(12)} | {"empty": "", "hot": " ".join(f"{text(6)}." for _ in range(60))}
    edges = []
    for i in range(250):
        source = r.choice([*pages, "absent", "hot", "hot"])
        body = pages.get(source) or "nothing at all"
        at = r.randrange(len(body))
        edges.append((i, source, r.choice([None, "", body[at : at + 15].upper(), "zebra zebra", f"  {body[:12]} "]), r.choice([text(r.randint(1, 8)), text(5), None, "...", body[at : at + 40]])))
    edges += edges[:3] + [(900, "p1", "zebra", "Heron"), (900, "p1", "zebra", "unheard of words here"), (901, None, "x", "y")]
    frame = spark.createDataFrame(edges, EDGES).repartition(3)
    body = spark.createDataFrame([*pages.items(), ("null", None)], "source string, body string")
    for threshold in (0.55, 0.3, 1.0):
        got = sorted((tuple(x) for x in evidence.check(frame, body, threshold).collect()), key=str)
        assert got == brute(edges, pages, threshold)
    assert {s for _, _, s, *_ in got} == {"quoted", "supported", "unsupported", "missing_source"}
    rules = {(x.rule, x.edge_id) for x in evidence.findings(evidence.check(frame, body)).collect()}
    assert ("evidence_missing_source", 901) in rules and {x for x, _ in rules} == {"evidence_missing_source", "evidence_unsupported"}


def test_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    pages = spark.createDataFrame([], "source string, body string")
    assert evidence.check(none, pages).count() == 0
    assert [x.status for x in evidence.check(spark.createDataFrame([(1, "a", "q", "c")], EDGES), pages).collect()] == ["missing_source"]
