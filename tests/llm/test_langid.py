import random
import re
import zlib
from collections import Counter

from foldstore.llm import langid


def plain_profile(text, most=langid.PROFILE):
    """The method by dictionaries."""
    code = lambda c: 0 if c == "_" else int(langid.letters()[ord(c)])
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if not all(langid.letters()[ord(c)] for c in w):
            return None
        p = f"_{w}_"
        for c in w:
            counts[code(c) + langid.GRAMS + langid.ALPHABET**2] += 1
        for i in range(len(p) - 1):
            counts[code(p[i]) * langid.ALPHABET + code(p[i + 1]) + langid.GRAMS] += 1
        for i in range(len(p) - 2):
            if not (p[i] == "_" and p[i + 2] == "_"):
                counts[(code(p[i]) * langid.ALPHABET + code(p[i + 1])) * langid.ALPHABET + code(p[i + 2])] += 1
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:most]


TEXTS = ["The quick brown fox, the lazy dog.", "Der schnelle Fuchs über den Hund; Straße!", "a", "x y z x", "Élan vital, où l'été?"]


def test_profiles_equal_the_plain_method():
    for t in TEXTS:
        assert langid.ranked(langid.numbers(t)).tolist() == plain_profile(t)


def test_distance_equals_the_plain_method():
    profiles = {"en": plain_profile(TEXTS[0]), "de": plain_profile(TEXTS[1])}
    model = langid.Profiles(profiles)
    for t in TEXTS:
        mine = plain_profile(t)
        away = {}
        for lang, p in profiles.items():
            rank = {g: k for k, g in enumerate(p)}
            away[lang] = sum(abs(rank[g] - k) if g in rank else langid.PROFILE for k, g in enumerate(mine))
        lang, score = model.predict(t)
        assert lang == min(sorted(away), key=away.get) and 0 <= score <= 1


def test_query_form(spark, corpus):
    profiles = langid.fit(corpus)
    rows = langid.predict(corpus, profiles, corpus.columns).collect()
    assert len(rows) == corpus.count() and set(profiles) == {"de", "en"}
    by = {r.doc_id: (r.lang_pred, r.lang_score) for r in rows}
    for i in (220, 221, 222, 227):
        assert by[i] == ("und", 0.0)
    assert by[223][0] in profiles and by[228][0] in profiles
    assert langid.fit(corpus.limit(0)) == {} and langid.Profiles({}).predict("hello") == ("und", 0.0)
    assert langid.predict(corpus.limit(0), profiles, ["doc_id"]).count() == 0


def test_held_out_rows_teach_nothing(spark):
    import zlib

    rows = [(i, "foo bar baz" if zlib.crc32(str(i).encode()) % 4 != 2 else "qqq www", "en") for i in range(50)]
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    assert got == plain_profile(" ".join(["foo bar baz"] * sum(r[1] != "qqq www" for r in rows)))


def test_whole_of_fit_and_predict_against_plain_lists(spark):
    """Counts, ranks and distances once more, with dictionaries."""
    r = random.Random(9)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}
    rows = [(i, " ".join("".join(r.choice(letters[g]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))), g if i % 7 else None) for i, g in enumerate(r.choice(list(letters)) for _ in range(300))]

    def grams(text):
        out = Counter()
        for w in text.split():
            p = f"_{w}_"
            out.update(w)
            out.update(p[k : k + 2] for k in range(len(p) - 1))
            out.update(p[k : k + 3] for k in range(len(p) - 2) if len(w) > 1)
        return out

    number = lambda g: [0 if c == "_" else ord(c) - 96 for c in g]
    value = lambda g: (lambda n: n[0] + langid.GRAMS + langid.ALPHABET**2 if len(n) == 1 else n[0] * langid.ALPHABET + n[1] + langid.GRAMS if len(n) == 2 else (n[0] * langid.ALPHABET + n[1]) * langid.ALPHABET + n[2])(number(g))
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], value(x[0])))][: langid.PROFILE]
    profiles = {}
    for i, text, g in rows:
        if g and zlib.crc32(str(i).encode()) % langid.FOLDS != langid.HELD_OUT:
            profiles.setdefault(g, Counter()).update(grams(text))
    profiles = {g: {x: k for k, x in enumerate(rank(c))} for g, c in profiles.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.predict(df, langid.fit(df), ["doc_id"]).collect()}
    for i, text, _ in rows:
        top = rank(grams(text))
        away = {g: sum(abs(p[x] - k) if x in p else langid.PROFILE for k, x in enumerate(top)) for g, p in profiles.items()}
        assert got[i] == min(sorted(away), key=away.get), i
