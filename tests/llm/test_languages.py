"""Languages are told apart by their value."""

from keystrata.llm import rules

SCHEMA = "doc_id long, text string, lang string"


def prose(k, words):
    return " ".join(f"{words[(i * i + k * i) % len(words)]}{(i + k) % 5}" for i in range(60))


def test_a_language_is_judged_apart_from_all_others(spark):
    many = ["der", "und", "nicht", "haus", "wald", "regen"]
    few = {"pl": ["nie", "jest", "dom", "las"], "": ["xx", "yy", "zz"], None: ["qa", "qe", "qi"]}
    rows = {"de": [(k, prose(k, many), "de") for k in range(40)]}
    for n, (lang, words) in enumerate(few.items(), 1):
        rows[lang] = [(100 * n + k, prose(k, words), lang) for k in range(8)]
    both = rules.judge(spark.createDataFrame(sum(rows.values(), []), SCHEMA).repartition(3)).collect()
    assert len(both) == 64
    got = {r.doc_id: r for r in both}
    for own in rows.values():
        for r in rules.judge(spark.createDataFrame(own, SCHEMA)).collect():
            x = got[r.doc_id]
            assert r.kept == x.kept
            for a, b in ((r.log_perplexity, x.log_perplexity), (r.band_low, x.band_low), (r.band_high, x.band_high)):
                assert abs(a - b) < 1e-9
