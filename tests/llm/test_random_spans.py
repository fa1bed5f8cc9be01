"""Random spans: keys of several kinds are found, words of several languages are not."""

import math
import random

from keystrata.llm import secrets

SCHEMA = "doc_id long, text string"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def found(spark, texts):
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    out = {}
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("random")]
        out[r.doc_id] = [texts[r.doc_id][int(a) : int(b)] for _, a, b in spans]
    return out


def test_keys_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    alone, behind, short = key(40), key(32), key(24)
    texts = [
        f"see {alone} here", f"at /downloads/archive/files/{behind} today", f"id={short};",
        "donaudampfschifffahrtsgesellschaftskapitaen internationalisation_of_configuration-settings2024",
        "anticonstitutionnellement/descriptions-supplementaires/rechtsschutzversicherungsgesellschaften",
        "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA1 abababababababababababababababab12 12345678901234567890", "====================", None,
    ]
    got = found(spark, texts)
    assert alone in got[0] and behind in got[1] and short in got[2]
    assert not any(got[k] for k in range(3, 8))


def test_evidence_equals_a_plain_computation(spark):
    body = "x9Kq3LmZp8Rt2VwYb7Nc4HdJ5sFgT6Qe1A"
    got = secrets.battery(spark.createDataFrame([(body,)], "body string")).first()._evidence
    at = [secrets.ALPHABETS["base64"].index(c) for c in body]
    n, a = len(at), 64
    text = {c: 0.03 / 10 for c in "0123456789"} | {chr(65 + k): 0.05 * p / 1000 for k, p in enumerate(secrets.LETTERS)} | {chr(97 + k): 0.9 * p / 1000 for k, p in enumerate(secrets.LETTERS)}
    ratio = sum(-math.log(text[c]) for c in body) - n * math.log(a)
    chi = max(0, (a / n * sum(at.count(k) ** 2 for k in range(a)) - n - (a - 1)) / math.sqrt(2 * (a - 1)))
    up = sum(x >= a / 2 for x in at)
    mean = 1 + 2 * up * (n - up) / n
    runs = 1 + sum((x >= a / 2) != (y >= a / 2) for x, y in zip(at, at[1:]))
    serial = sum((x - (a - 1) / 2) * (y - (a - 1) / 2) for x, y in zip(at, at[1:])) / ((a * a - 1) / 12) / math.sqrt(n - 1)
    tail = lambda z: 0.717 * abs(z) + 0.416 * z * z
    least = max(tail(chi), tail((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))), tail(serial))
    assert abs(got - max(0, ratio - max(0, least - math.log(3)))) < 1e-6
