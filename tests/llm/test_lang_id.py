import zlib
from collections import Counter

from sitelens.llm import lang_id, queries


def test_held_out_accuracy(spark, sf, documents):
    got = queries.op6_language(spark, sf).collect()
    assert len(got) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in own) >= 0.97 * len(own)


def test_distance_matches_a_plain_count(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    profiles = lang_id.fit(docs)

    def grams(text):
        out = Counter()
        for n in (1, 2, 3):
            line = "_" + "_".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "_"
            for k in range(len(line) - n + 1):
                g = line[k : k + n]
                if g != "_" and not (n == 3 and g[1] == "_"):
                    out[g] += 1
        return out

    code = lambda g: sum((0 if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) | {1: 0, 2: 1 << 62, 3: 1 << 63}[len(g)]
    text = "the hound and a cat"
    own = sorted(grams(text).items(), key=lambda kv: (-kv[1], code(kv[0])))
    best = {}
    for lang, profile in profiles.items():
        ranks = {g % (1 << 64): k for k, g in enumerate(profile)}
        best[lang] = sum(abs(ranks[code(g)] - k) if code(g) in ranks else lang_id.PROFILE for k, (g, _) in enumerate(own))
    row = spark.createDataFrame([(text,)], "text string")
    got = lang_id.identify(row, profiles).first().language
    assert got.lang == min(best, key=best.get) and abs(got.score - (1 - min(best.values()) / (lang_id.PROFILE * len(own)))) < 1e-12


def test_odd_rows(odd, none):
    profiles = lang_id.fit(odd)
    got = {r.doc_id: r.language for r in lang_id.identify(odd, profiles).collect()}
    assert got[2].lang == got[3].lang == got[4].lang == got[5].lang == "und" and got[0].lang == "en" and got[9].lang == "es"
    assert lang_id.fit(none) == {}
    assert lang_id.identify(odd, {}).where("language.lang = 'und'").count() == 13
    assert lang_id.identify(none, profiles).collect() == []


def test_bounds_of_known_languages(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles, least = lang_id.fit_known(docs)
    assert profiles == lang_id.fit(docs)
    rows = lang_id.identify(docs, profiles).collect()
    for lang, bound in least.items():
        scores = sorted(r.language.score for r in rows if r.language.lang == lang == r.lang)
        assert bound == 0.5 * scores[(len(scores) - 1) // 2]
    assert lang_id.fit_known(none) == ({}, {})
    profiles, least = lang_id.fit_known(odd.withColumn("place", lang_id.F.lit(1)))
    assert profiles.keys() == least.keys() == {"en", "de", "fr", "es"} and least["de"] == 0.0 < least["en"]
