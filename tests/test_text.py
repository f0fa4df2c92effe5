import html
import random
import re
import unicodedata

from pyspark.sql import functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.operators.normalize import with_normalized

# The fuzz alphabet: ASCII of every step, compatibility forms, combining marks,
# look-alikes, invisible characters, several scripts and kinds of white space.
ALPHABET = (
    "abshtfuckmd e i o 0134578 @@__--..**##$$!!|| \n\t&;'"
    "　  \x1c\x85éñß́½²ａｂ​­"
    "арсαΣİकाஹித்"
)
LOOKALIKE = dict(zip("аеорсхӏіуαεο", "aeopcxiiyaeo"))


def expected(text):
    text = "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFKC", text) if ord(c) not in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD))
    text = re.sub("[ऀ-ॿ]+", " ", text).lower()
    text = re.sub(r"(?<![a-z0-9])@\w+", " usermention ", text)
    text = re.sub(r"(.)\1{2,}", r"\1\1", text)
    text = text.translate(str.maketrans("@$013457!|", "asoieastii"))
    spelled = r"\b(?:[a-z0-9][\s._\-*@#$!|]+)+[a-z0-9]\b"
    text = re.sub(spelled, lambda m: re.sub(r"[^a-z0-9\-]", "", m.group()), text)
    text = re.sub(r"\bsh[\W_]*t\b", "shit", text)
    text = re.sub(r"\bf[\W_]*u[\W_]*c[\W_]*k\b", "fuck", text)
    return " ".join(re.findall(r"[a-z0-9\-]+", text))


def test_normalisation_fuzz(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    texts += ["a " * 20_000, "a_" * 20_000, "a-b", "a - b", "a_b_", "a_b_c d", "snake_case_x y z", "ｔｕ bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    both = with_normalized(df).withColumn("single", tx.normalize_text("text"))
    got = {r.id: (r.normalized_text, r.single) for r in both.collect()}
    wrong = [t for i, t in enumerate(texts) if got[i] != (expected(t), expected(t))]
    assert not wrong


def test_scalars_match_python(spark):
    rng = random.Random(8)
    pool = ALPHABET + "https://x.y/z 1.2.3.4 a@b.co @name &amp; &lt; &#39; &eacute; 1234567890"
    words = ["https://x.y/z", "1.2.3.4", "é1.2.3.4", "a@b.co", "@name", "&amp;", "&#39;", "&eacute;", "12345678901", "hai", "TU"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = df.select(
        "text", tx.redact_text("text").alias("redacted"), tx.plain_text("text").alias("plain"),
        tx.has_email("text").alias("email"), tx.has_phone("text").alias("phone"), tx.preview("text").alias("preview"),
        tx.nfkc("text").alias("nfkc"),
    ).collect()
    for r in rows:
        t = r.text
        red = re.sub(r"@\w+", "@user", re.sub(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[ip]", re.sub(r"https?://\S+", "[link]", t)))
        assert r.redacted == re.sub(r"\s+", " ", red).strip()[:280]
        assert r.plain == " ".join(html.unescape(t).split())
        assert r.email == bool(re.search(r"[\w.-]+@[\w.-]+\.\w+", t))
        assert r.phone == bool(re.search(r"\b\d{10,}\b", t))
        assert r.preview == t[:72] + ("…" if len(t) > 72 else "")
        assert r.nfkc == unicodedata.normalize("NFKC", t)


def test_languages_and_labels(spark):
    df = spark.createDataFrame([("फिल्म",), ("tu kar",), ("fine",)], "text string")
    assert [r.v for r in df.select(tx.language_mix("text").alias("v")).collect()] == ["hindi_devanagari", "hinglish_latin", "english"]
    labels = spark.createDataFrame([('["a"]',), ('{"a":1}',), ("oops",), ("",)], "j string")
    assert [(r.j, r.l) for r in labels.select(tx.is_json("j").alias("j"), tx.is_json_list("j").alias("l")).collect()] == [
        (True, True), (True, False), (False, False), (False, False)]
    assert df.select(F.max(tx.has_devanagari("text"))).first()[0]


def romanised(text):
    """The scheme character by character."""
    cons, signs, pairs = (tx._letters(t) for t in (fv.IAST_CONSONANTS, fv.IAST_SIGNS, fv.IAST_NUKTA_PAIRS))
    rest, out, i = tx._letters(fv.IAST_VOWELS) | signs | tx._letters(fv.IAST_OTHERS), [], 0
    while i < len(text):
        x, i = text[i], i + 1
        if x not in cons:
            out.append("" if x in (fv.NUKTA, fv.VIRAMA) else rest.get(x, x))
            continue
        dotted = text[i : i + 1] == fv.NUKTA
        i += dotted
        out.append(pairs.get(x + fv.NUKTA, cons[x]) if dotted else cons[x])
        if text[i : i + 1] not in signs and text[i : i + 1] != fv.VIRAMA:
            out.append("a")
    return "".join(out)


def test_devanagari_to_latin_letters(spark):
    words = {
        "किताब": "kitāba", "हिन्दी": "hindī", "संस्कृतम्": "saṃskṛtam", "ज़िन्दगी": "zindagī", "लड़का": "laṛakā", "ॐ": "oṃ",
        "क्षत्रिय": "kṣatriya", "ज्ञान": "jñāna", "दुःख": "duḥkha", "राम।": "rāma.", "१२ घर": "12 ghara", "अँ": "am̐", "ऐसा": "aisā",
        "पढ़ाई": "paṛhāī", "औरत": "aurata", "खै": "khai", "सोऽहम्": "so’ham", "": "", "abc é": "abc é", "\u0915\u093c": "qa", "\u0958\u093f": "qi",
    }
    rng = random.Random(3)
    script = [chr(c) for c in range(0x900, 0x980)] + list("कखगढफ") * 6 + [fv.NUKTA, fv.VIRAMA] * 12 + list(" ab$\\\n")
    texts = ["".join(rng.choice(script) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    given = [*words, *texts, "कि" * 200_000, None]
    rows = spark.createDataFrame(list(enumerate(given)), "id long, text string")
    got = {r.id: r.value for r in rows.select("id", tx.iast("text").alias("value")).collect()}
    assert [got[i] for i in range(len(words))] == list(words.values())
    assert all(got[i] == (None if t is None else romanised(t)) for i, t in enumerate(given))
    chain = with_normalized(rows.where("id < 2"), transliterator=tx.iast).withColumn("one", tx.normalize_text("text", tx.iast))
    assert {(r.id, r.normalized_text, r.one) for r in chain.collect()} == {(0, "kit ba", "kit ba"), (1, "hind", "hind")}


def test_the_sql_of_plain_text_reads_references_as_html_does(spark):
    """Names cut off before their ;, the longest known name, numbers of other code pages, null."""
    import duckdb
    import pyarrow as pa

    from oracle.sql import ORACLES

    pages = [
        (0, "a = &quot"), (1, "&quotb &copy2024 &middot"), (2, "&notit; &notin; &ampamp; &amp;lt;"), (3, None), (4, ""),
        (5, "&#128;&#0;&#xD800;&#1;&#x1F600;&#99999999999; &#x &#; &"), (6, "x&nbsp;&#12288; y&NewLine;z"), (7, "&zzz; &&gt&a &acE;"),
    ]
    got = spark.createDataFrame(pages, "page_id long, html string").select("page_id", tx.plain_text("html"))
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [k for k, _ in pages], "html": pa.array([t for _, t in pages], pa.string())}))
    assert {tuple(r) for r in got.collect()} == set(con.execute(ORACLES["t19_plain_text"]).fetchall())
