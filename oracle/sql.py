"""SQL restatements of the registered queries, for DuckDB on the same tables.

They are written apart from the Spark code and in other terms where that is
possible: matching is a join, rounding is decimal formatting, repeated letters
are a list filter.  Only the fixed values are shared.
"""

import html
from html import entities

from commentguard import fixed_values as fv
from commentguard.plans.inputs import AS_DEVANAGARI, LATIN
from commentguard.plans.sample_texts import SAMPLE_COMMENTS

ORACLES: dict[str, str] = {}


def q(value: str) -> str:
    """A string literal; control and invisible characters go through chr()."""
    plain, parts = "", []
    for c in value:
        if c.isprintable():
            plain += c.replace("'", "''")
        else:
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
    return " || ".join([*parts, f"'{plain}'"]) if parts else f"'{plain}'"


def paren(value: str) -> str:
    return f"({q(value)})"


def qlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def pick(values, index: str) -> str:
    return "[" + ", ".join(q(v) for v in values) + f"][CAST({index} AS BIGINT) + 1]"


def round_to(x: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE)"


# --- Inputs ------------------------------------------------------------------

DOCS = f"""SELECT doc_id AS comment_id, text, lang, source,
  {pick(fv.CONTEXT_TYPES, 'doc_id % 4')} AS context_type, {pick(fv.RATINGS, 'doc_id % 4')} AS rating,
  CAST(doc_id % 101 AS DOUBLE) AS perf, CAST((doc_id * 7) % 101 AS DOUBLE) AS skip,
  CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100e0 END AS given
FROM documents"""
CONV = f"""SELECT conv_id, turn, role, text,
  CASE WHEN turn = 0 THEN 'main_review' ELSE 'reply_to_comment' END AS context_type,
  {pick(fv.RATINGS, 'conv_id % 4')} AS rating,
  CAST(conv_id % 101 AS DOUBLE) AS perf, CAST((conv_id * 7) % 101 AS DOUBLE) AS skip,
  CAST(NULL AS DOUBLE) AS given
FROM conversations"""
_SAMPLES = ", ".join(
    f"({i}, {q(t)}, {q(c)}, {q(r)}, {dbl(p)}, {dbl(s)})" for i, (t, c, r, p, s) in enumerate(SAMPLE_COMMENTS)
)
EVENTS = f"""SELECT event_id AS comment_id, ts, user_id AS client_id, event_type, value / 100e0 AS latency_s,
  s.text, s.context_type, s.rating, s.perf, s.skip, CAST(NULL AS DOUBLE) AS given
FROM events JOIN (VALUES {_SAMPLES}) s(sid, text, context_type, rating, perf, skip)
  ON event_id % {len(SAMPLE_COMMENTS)} = s.sid"""
TEXTS = f"""SELECT 'doc' AS src, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
UNION ALL SELECT 'conv', conv_id, turn, text FROM conversations
UNION ALL SELECT 'event', comment_id, 0, text FROM ({EVENTS})"""
TRUE_ACTION = """CASE WHEN toxic = 1 AND quality = 1 THEN 'flag_for_review'
  WHEN toxic = 1 THEN 'flag_for_removal' ELSE 'allow' END"""
LABELLED = f"""SELECT d.*, quality, toxic, {TRUE_ACTION} AS moderation_action
FROM ({DOCS}) d JOIN labels l ON d.comment_id = l.doc_id"""

# --- Text steps --------------------------------------------------------------

WORD = r"\p{L}\p{N}_"
SPACES = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LETTER_MARK = "chr(1)"


def mention(v: str) -> str:
    marked = rf"regexp_replace({v}, '([a-z0-9])@', '\1' || {LETTER_MARK}, 'g')"
    return f"replace(regexp_replace({marked}, '@[{WORD}]+', ' {fv.MENTION_TOKEN} ', 'g'), {LETTER_MARK}, '@')"


def squeeze(chars: str) -> str:
    """``chars`` is a list of characters."""
    return (
        f"array_to_string(list_filter({chars}, lambda c, i: NOT (i > 2 AND c = {chars}[i - 1] "
        f"AND c = {chars}[i - 2] AND c <> chr(10))), '')"
    )


def ascii_words(v: str) -> str:
    """Non-ASCII word characters to Q, other non-ASCII characters to blanks or ~."""
    v = rf"regexp_replace({v}, '[\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')"
    v = rf"regexp_replace({v}, '[^\x00-\x7f\p{{L}}\p{{N}}]', '~', 'g')"
    return rf"regexp_replace({v}, '[^\x00-\x7f]', 'Q', 'g')"


_SPLIT_RE = r"\b(?:[a-z0-9][\x09-\x0d\x1c-\x20._\-*@#$!|]+)+[a-z0-9]\b"


def join_split(v: str) -> str:
    return (
        f"array_to_string(list_transform(string_split_regex({v}, '{_SPLIT_RE}'), lambda p, i: p || "
        f"coalesce(regexp_replace(regexp_extract_all({v}, '{_SPLIT_RE}')[i], '[^a-z0-9-]', '', 'g'), '')), '')"
    )


def shit(v: str) -> str:
    return rf"regexp_replace({v}, '\bsh[\W_]*t\b', 'shit', 'g')"


def fuck(v: str) -> str:
    return rf"regexp_replace({v}, '\bf[\W_]*u[\W_]*c[\W_]*k\b', 'fuck', 'g')"


def symbols(v: str) -> str:
    return f"trim(regexp_replace({v}, '[^a-z0-9-]+', ' ', 'g'))"


DEVANAGARI = r"[\x{0900}-\x{097f}]"


def norm_ctes(source: str) -> str:
    """CTEs that end in norm(text, nt, toks), one row per distinct text."""
    cleaned = f"translate(nfc_normalize(text), {paren(fv.CONFUSABLES_FROM + fv.ZERO_WIDTH)}, {q(fv.CONFUSABLES_TO)})"
    return f"""n0 AS (SELECT DISTINCT text FROM ({source})),
n1 AS (SELECT text, lower(regexp_replace({cleaned}, '{DEVANAGARI}+', ' ', 'g')) AS v FROM n0),
n2 AS (SELECT text, string_split({mention('v')}, '') AS cs FROM n1),
n3 AS (SELECT text, translate({squeeze('cs')}, {q(fv.LEET_FROM)}, {q(fv.LEET_TO)}) AS v FROM n2),
n4 AS (SELECT text, {ascii_words('v')} AS v FROM n3),
n5 AS (SELECT text, {join_split('v')} AS v FROM n4),
n6 AS (SELECT text, {symbols(fuck(shit('v')))} AS nt FROM n5),
norm AS (SELECT text, nt, regexp_extract_all(nt, '[a-z0-9-]+') AS toks FROM n6)"""


def lexicon_values(lists: dict) -> str:
    rows = [f"({q(n)}, {q(p)}, {q(p.split(' ')[0])}, {str(' ' in p).lower()})" for n, ps in lists.items() for p in ps]
    return f"lex(list, phrase, first, is_phrase) AS (VALUES {', '.join(rows)})"


MATCHERS = ["severe", "threat", "soft", "profanity", "directed_attack", "protected_abuse", "group_target"]
SIGNALS = [*MATCHERS, "movie", "user", "community", "hate_word", "fan_word"]


def hits_ctes() -> str:
    """hits(text, list, phrase) for the lists that match by first token; loose
    lists may also match a phrase without its first token."""
    return f"""{lexicon_values(fv.LEXICON)},
words AS (SELECT text, nt, unnest(list_distinct(toks)) AS tok FROM norm),
hits AS (SELECT text, list, phrase FROM words JOIN lex ON tok = first
  WHERE NOT is_phrase OR contains(nt, phrase)),
loose AS (SELECT text, list FROM norm JOIN lex ON list IN ('hate_word', 'fan_word') AND is_phrase AND contains(nt, phrase)),
anyhit AS (SELECT text, list FROM hits UNION ALL SELECT text, list FROM loose),
sig AS (SELECT n.text, n.nt, n.toks, list_contains(n.toks, '{fv.MENTION_TOKEN}') AS has_mention,
  {', '.join(f"coalesce(bool_or(list = '{s}'), false) AS {s}" for s in SIGNALS)}
  FROM norm n LEFT JOIN anyhit h ON n.text = h.text GROUP BY ALL)"""


def v1_ctes(source: str) -> str:
    def anywhere(name):
        return "(" + " OR ".join(f"contains(nt, {q(t)})" for t in fv.LEXICON_V1[name]) + ")"

    def token(words):
        return f"list_has_any(toks, [{', '.join(q(w) for w in words)}])"

    lists = [*MATCHERS, "community", "hate_word", "fan_word"]
    return rf"""v0 AS (SELECT DISTINCT text FROM ({source})),
v1 AS (SELECT text, string_split(regexp_replace(lower(text), '@[{WORD}]+', '@user', 'g'), '') AS cs FROM v0),
v2 AS (SELECT text, trim(regexp_replace({squeeze('cs')}, '[^a-z0-9@-]+', ' ', 'g')) AS nt FROM v1),
v3 AS (SELECT text, nt, string_split(nt, ' ') AS toks FROM v2),
sig AS (SELECT text, nt, toks, contains(nt, '@user') AS has_mention,
  {', '.join(f"{anywhere(n)} AS {n}" for n in lists)},
  {token(['@user', *fv.LEXICON_V1['user']])} AS "user", {token(fv.LEXICON_V1['movie'])} AS movie FROM v3)"""


def count_terms(terms) -> str:
    return "(" + " + ".join(f"CAST(contains(nt, {q(t)}) AS INT)" for t in terms) + ")"


REPLY = f"context_type IN {qlist(fv.REPLY_CONTEXTS)}"
PEOPLE = qlist(fv.PERSON_OR_GROUP_TARGETS)
NOT_CONTENT = qlist([*fv.PERSON_OR_GROUP_TARGETS, "unknown"])
CONTENT = qlist(fv.CONTENT_TARGETS)


def target_case(v1: bool) -> str:
    reply_rungs = "" if v1 else f"WHEN {REPLY} AND severe THEN 'reviewer_or_user'"
    soft_rung = "" if v1 else f"WHEN {REPLY} AND soft THEN 'reviewer_or_user'"
    return f"""CASE WHEN protected_abuse THEN 'protected_class'
  WHEN community THEN CASE WHEN hate_word THEN 'protected_class' ELSE 'review_content' END
  WHEN group_target THEN 'community_identity'
  WHEN directed_attack THEN 'reviewer_or_user' {reply_rungs}
  WHEN "user" AND (soft OR severe OR threat) THEN 'reviewer_or_user'
  WHEN "user" AND {REPLY} AND NOT movie THEN 'reviewer_or_user' {soft_rung}
  WHEN movie THEN 'movie_show' WHEN fan_word THEN 'community_identity' ELSE 'unknown' END"""


def decision_ctes(source: str, weights: dict | None = None, v1: bool = False) -> str:
    """CTEs that end in d(..., all decision columns), one row per source row.

    ``source`` gives text, context_type, rating, perf, skip, given and its keys.
    """
    w = weights or fv.WEIGHT_PROFILES["v1" if v1 else "current"]
    points = " + ".join(f"CASE WHEN {n} THEN {dbl(p)} ELSE 0e0 END" for n, p in fv.TOXICITY_POINTS.items())
    base = v1_ctes("SELECT text FROM src") if v1 else norm_ctes("SELECT text FROM src") + ",\n" + hits_ctes()
    escalation = "" if v1 else "WHEN directed_attack AND severe THEN ['flag_for_removal', 'personal_attack', 'insult', 'high']"
    protected = "protected_abuse AND target = 'protected_class'" if v1 else "protected_abuse"
    codes = [
        ("has_mention", "MENTION_OR_DIRECT_REPLY"), ("disagreement > 0", "RATING_DISAGREEMENT_RISK"),
        ("negative", "NEGATIVE_SENTIMENT"), (f"target IN {CONTENT}", "TARGETS_MOVIE_OR_REVIEW_CONTENT"),
        (f"target IN {PEOPLE}", "TARGETS_PERSON_OR_GROUP"), ("profanity", "PROFANITY_SIGNAL"),
        ("soft", "SOFT_ABUSE_SIGNAL"), ("directed_attack", "DIRECTED_ATTACK_PATTERN"),
        ("severe", "SEVERE_ABUSE_SIGNAL"), ("threat", "THREAT_SIGNAL"),
        ("protected_abuse", "PROTECTED_CLASS_ABUSE_PATTERN"),
    ]
    code_list = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in codes)
    e = fv.EXPLANATIONS
    return f"""src AS ({source}),
{base},
e0 AS (SELECT src.*, sig.* EXCLUDE (text), {target_case(v1)} AS target,
  {count_terms(fv.NEGATIVE_TERMS)} - {count_terms(fv.POSITIVE_TERMS)} AS balance,
  {round_to(f'least({points}, 1e0)', 3)} AS htox,
  CASE WHEN lower(rating) = 'skip' AND perf >= 80 THEN 0.25e0
       WHEN lower(rating) = 'perfection' AND skip >= 35 THEN 0.15e0 ELSE 0e0 END AS disagreement
  FROM src JOIN sig USING (text)),
e1 AS (SELECT *, coalesce(CASE WHEN NOT isnan(given) THEN given END, htox) AS model, balance > 0 AS negative FROM e0),
e2 AS (SELECT *, {round_to(f'''least(CASE WHEN {REPLY} THEN {dbl(w["reply_context_base"])} ELSE {dbl(w["main_review_base"])} END
  + CASE WHEN has_mention THEN {dbl(w["has_mention"])} ELSE 0e0 END
  + CASE WHEN negative THEN {dbl(w["negative_sentiment"])} ELSE 0e0 END
  + disagreement + greatest(htox, model) * {dbl(w["toxicity_scale"])}, 1e0)''', 3)} AS risk FROM e1),
e3 AS (SELECT *, CASE WHEN threat THEN ['flag_for_removal', 'threat_or_violence', 'threat', 'critical']
  WHEN {protected} THEN ['flag_for_removal', 'hate_or_identity_attack', 'insult', 'high']
  WHEN severe AND target = 'protected_class' THEN ['flag_for_removal', 'hate_or_identity_attack', 'insult', 'high']
  WHEN severe AND target IN {NOT_CONTENT} THEN ['flag_for_removal', 'personal_attack', 'insult', 'high']
  {escalation}
  WHEN directed_attack AND target IN {NOT_CONTENT} THEN ['flag_for_review', 'harassment', 'trolling', 'medium']
  WHEN soft AND target IN {PEOPLE} THEN ['flag_for_review', 'harassment', 'trolling', 'medium']
  WHEN model >= {dbl(w["flag_for_review_model"])} AND target NOT IN {CONTENT} THEN ['flag_for_review', 'harassment', 'insult', 'medium']
  WHEN risk >= {dbl(w["flag_for_review_risk"])} AND target IN {NOT_CONTENT} THEN ['flag_for_review', 'harassment', 'trolling', 'low']
  WHEN negative THEN ['allow', 'non_abusive', 'criticism', 'none']
  ELSE ['allow', 'non_abusive', 'normal_discussion', 'none'] END AS verdict FROM e2),
d AS (SELECT *, verdict[1] AS predicted_action, verdict[2] AS predicted_category, verdict[3] AS predicted_intent,
  verdict[4] AS predicted_severity, target AS target_detected_pred,
  CASE WHEN balance > 0 THEN 'negative' WHEN balance < 0 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
  round(1e0 / (1e0 + exp(-CAST(balance AS DOUBLE))), 3) AS sentiment_score, risk AS risk_score,
  htox AS heuristic_toxicity_score, {round_to('model', 3)} AS model_toxicity_score,
  array_to_string(list_filter([{code_list}], lambda x: x IS NOT NULL), '|') AS reason_codes, '' AS triggered_rules,
  CASE WHEN verdict[1] = 'allow' AND target IN {CONTENT} THEN {q(e['allow_content'])}
    WHEN verdict[1] = 'allow' THEN {q(e['allow'])}
    WHEN verdict[1] = 'flag_for_review' THEN {q(e['flag_for_review'])} ELSE {q(e['flag_for_removal'])} END AS reason
  FROM e3)"""


DECISION = """predicted_action, predicted_category, predicted_intent, predicted_severity, target_detected_pred,
sentiment_label, sentiment_score, risk_score, heuristic_toxicity_score, model_toxicity_score, reason_codes,
triggered_rules, reason"""


def decided(source: str, select: str, extra: str = "", **options) -> str:
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in extra else ''}{decision_ctes(source, **options)}{extra.replace('RECURSIVE', '')}\n{select}"


# --- Flagship and text -------------------------------------------------------

ORACLES["decisions_by_language"] = decided(
    DOCS, "SELECT lang, predicted_action, count(*) AS n, round(sum(risk_score), 3) AS total_risk FROM d GROUP BY ALL"
)


def scalar(name: str, value: str) -> None:
    ORACLES[name] = f"SELECT src, id, part, {value} AS value FROM ({TEXTS})"


scalar("t01_nfkc", "nfc_normalize(text)")
scalar("t02_strip_zero_width", "array_to_string(list_filter(string_split(text, ''), lambda c: unicode(c) NOT IN (8203, 8204, 8205, 65279, 173)), '')")
scalar("t03_map_confusables", f"translate(text, {q(fv.CONFUSABLES_FROM)}, {q(fv.CONFUSABLES_TO)})")
scalar("t04_has_devanagari", f"regexp_matches(text, '{DEVANAGARI}')")
scalar("t05_transliterate", f"regexp_replace(text, '{DEVANAGARI}+', ' ', 'g')")


def _letter_map(table: str) -> str:
    parts = table.split(" ")
    return f"MAP {{{', '.join(f'{q(a)}: {q(b)}' for a, b in zip(parts[::2], parts[1::2], strict=True))}}}"


# Character by character: a consonant looks at the one or two that follow.
ORACLES["t05_transliterate_iast"] = f"""WITH c AS (SELECT src, id, part, string_split(translate(text, {q(LATIN)}, {q(AS_DEVANAGARI)}), '') AS c FROM ({TEXTS})),
m AS (SELECT {_letter_map(fv.IAST_CONSONANTS)} AS cons, {_letter_map(fv.IAST_SIGNS)} AS signs, {_letter_map(fv.IAST_NUKTA_PAIRS)} AS pairs,
  {_letter_map(fv.IAST_VOWELS + ' ' + fv.IAST_SIGNS + ' ' + fv.IAST_OTHERS)} AS rest)
SELECT src, id, part, array_to_string(list_transform(c, lambda x, i: CASE
  WHEN cons[x] IS NOT NULL THEN coalesce(CASE WHEN c[i + 1] = '{fv.NUKTA}' THEN pairs[x || '{fv.NUKTA}'] END, cons[x])
    || CASE WHEN signs[CASE WHEN c[i + 1] = '{fv.NUKTA}' THEN c[i + 2] ELSE c[i + 1] END] IS NOT NULL
      OR coalesce(CASE WHEN c[i + 1] = '{fv.NUKTA}' THEN c[i + 2] ELSE c[i + 1] END, '') = '{fv.VIRAMA}' THEN '' ELSE 'a' END
  WHEN x IN ('{fv.NUKTA}', '{fv.VIRAMA}') THEN '' ELSE coalesce(rest[x], x) END), '') AS value FROM c, m"""
scalar("t06_lower", "lower(text)")
scalar("t07_mask_mentions", mention("lower(text)"))
ORACLES["t08_squeeze_repeats"] = (
    f"WITH c AS (SELECT src, id, part, string_split(lower(text), '') AS cs FROM ({TEXTS})) "
    f"SELECT src, id, part, {squeeze('cs')} AS value FROM c"
)
scalar("t09_deleet", f"translate(lower(text), {q(fv.LEET_FROM)}, {q(fv.LEET_TO)})")
ORACLES["t10_join_split_words"] = (
    f"WITH c AS (SELECT src, id, part, {ascii_words('lower(text)')} AS v FROM ({TEXTS})) "
    f"SELECT src, id, part, {symbols(join_split('v'))} AS value FROM c"
)
scalar("t13_strip_symbols", symbols("lower(text)"))
scalar("t16_detect_script", f"CASE WHEN regexp_matches(text, '{DEVANAGARI}') THEN 'hi_devanagari' ELSE 'unknown' END")
scalar(
    "t17_language_mix",
    f"CASE WHEN regexp_matches(text, '{DEVANAGARI}') THEN 'hindi_devanagari' "
    f"WHEN list_has_any(regexp_extract_all(lower(text), '[a-z0-9-]+'), [{', '.join(q(t) for t in fv.HINGLISH_TOKENS)}]) "
    "THEN 'hinglish_latin' ELSE 'english' END",
)


def redact(v: str) -> str:
    v = rf"regexp_replace({v}, 'https?://[^\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '[link]', 'g')"
    v = rf"regexp_replace({v}, '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b', '[ip]', 'g')"
    v = rf"regexp_replace({v}, '@[{WORD}]+', '@user', 'g')"
    v = rf"trim(regexp_replace({v}, '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
    return f"left({v}, {fv.TEXT_CAP})"


scalar("t18_redact_text", redact("text"))
scalar("t20_text_hash", "sha256(text)")
scalar("t24_preview", "CASE WHEN length(text) > 72 THEN left(text, 72) || '…' ELSE text END")


# Word boundaries of RE2 are ASCII only, so the neighbours are matched instead;
# two rounds, because neighbouring words share one.
def _bounded(pattern_head: str, body: str, word: str):
    """Replace ``body`` between non-word characters of any script."""

    def change(v: str) -> str:
        padded = f"(' ' || {v} || ' ')"
        once = rf"regexp_replace({padded}, '([^{WORD}]){pattern_head}{body}([^{WORD}])', '\1{word}\2', 'g')"
        twice = rf"regexp_replace({once}, '([^{WORD}]){pattern_head}{body}([^{WORD}])', '\1{word}\2', 'g')"
        return f"substr({twice}, 2, length({twice}) - 2)"

    return change


_GAP = r"[^\p{L}\p{N}]*"
scalar("t11_undisguise_shit", _bounded("sh", f"{_GAP}t", "shit")("lower(text)"))
scalar("t12_undisguise_fuck", _bounded("f", f"{_GAP}u{_GAP}c{_GAP}k", "fuck")("lower(text)"))
_NORM_TEXTS = f"WITH src AS ({TEXTS}),\n" + norm_ctes("SELECT text FROM src")
ORACLES["t14_normalize_text"] = f"{_NORM_TEXTS}\nSELECT src, id, part, nt AS value FROM src JOIN norm USING (text)"
ORACLES["t15_token_set"] = f"""{_NORM_TEXTS}
SELECT src, id, part, len(list_distinct(toks)) AS n_tokens,
  md5(array_to_string(list_sort(list_distinct(toks)), ' ')) AS tokens_md5 FROM src JOIN norm USING (text)"""
#: Character references as HTML reads them: decimal, hexadecimal or by name, the last ; optional.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\x09\x0a\x0c <&#;]{1,32};?)"
_NAMED = ", ".join(f"({q(name)}, {q(value)})" for name, value in sorted(entities.html5.items()))
#: Numbers that the standard maps to other characters (those of Windows-1252 for 128 to 159), and those it leaves out.
_RENUMBERED = ", ".join(f"({n}, {q(value)})" for n, value in sorted(html._invalid_charrefs.items()))
_LEFT_OUT = ", ".join(map(str, sorted(html._invalid_codepoints)))
# The longest known name counts, with or without its ;, and what follows it stays; a reference without one stays as it is.
ORACLES["t19_plain_text"] = rf"""WITH named(name, value) AS (VALUES {_NAMED}), renumbered(n, value) AS (VALUES {_RENUMBERED}),
u AS (SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html FROM pages),
cut AS (SELECT row, page_id, string_split_regex(html, '{_REFERENCE}') AS plain, regexp_extract_all(html, '{_REFERENCE}') AS refs FROM u),
piece AS (SELECT row, page_id, unnest(range(len(plain))) AS k, unnest(plain) AS plain, unnest(refs) AS ref FROM cut),
ref AS (SELECT DISTINCT ref FROM piece WHERE ref IS NOT NULL),
numbered AS (SELECT ref, ltrim(regexp_extract(ref, '^&#[xX]?([0-9a-fA-F]+)', 1), '0') AS digits, lower(ref[3]) = 'x' AS hex FROM ref WHERE ref[2] = '#'),
number AS (SELECT ref, CASE WHEN digits = '' THEN 0 WHEN length(digits) > 7 THEN 9999999
  WHEN hex THEN CAST('0x' || digits AS BIGINT) ELSE CAST(digits AS BIGINT) END AS n FROM numbered),
prefix AS (SELECT ref, substr(ref, 2) AS name, unnest(range(2, length(ref))) AS size FROM ref WHERE ref[2] <> '#'),
decoded AS (
  SELECT ref, CASE WHEN value IS NOT NULL THEN value WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
    WHEN n IN ({_LEFT_OUT}) THEN '' ELSE chr(CAST(n AS INTEGER)) END AS value
  FROM number LEFT JOIN renumbered USING (n)
  UNION ALL
  SELECT ref, arg_max(value || substr(prefix.name, size + 1), size)
  FROM prefix JOIN named ON named.name = substr(prefix.name, 1, size) GROUP BY ref),
v AS (SELECT row, page_id, string_agg(plain || coalesce(value, ref, ''), '' ORDER BY k) AS v
  FROM piece LEFT JOIN decoded USING (ref) GROUP BY row, page_id)
SELECT page_id, trim(regexp_replace(v, '{SPACES}+', ' ', 'g')) AS value FROM v"""
ORACLES["t21_cache_key"] = f"SELECT comment_id, sha256(text || ':' || context_type) AS value FROM ({DOCS})"
EMAIL = rf"regexp_matches(text, '[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]+')"
PHONE = rf"regexp_matches(' ' || text || ' ', '[^{WORD}]\d{{10,}}[^{WORD}]')"
ORACLES["t22_find_pii"] = f"SELECT src, id, part, {EMAIL} AS email, {PHONE} AS phone FROM ({TEXTS})"

EXAMPLE_SOURCES = f"""SELECT d.comment_id, d.text, d.context_type, source || '_' || d.comment_id AS scenario_id, coalesce(toxic, 0) = 1 AS tox,
  CASE WHEN coalesce(toxic, 0) = 1 THEN 'reviewer_or_user' ELSE 'movie_show' END AS target_detected,
  CASE WHEN coalesce(toxic, 0) = 1 AND quality = 1 THEN 'flag_for_review'
    WHEN coalesce(toxic, 0) = 1 THEN 'flag_for_removal' ELSE 'allow' END AS moderation_action,
  CASE WHEN coalesce(toxic, 0) = 1 THEN 'unsafe' ELSE 'safe' END AS label_primary,
  CASE WHEN coalesce(toxic, 0) = 1 THEN '["unsafe","personal_attack"]' ELSE '["safe","harsh_criticism"]' END AS labels_multi,
  CASE WHEN coalesce(toxic, 0) = 1 THEN 'personal_attack' ELSE 'non_abusive' END AS abuse_category,
  CASE WHEN coalesce(toxic, 0) = 1 THEN 'medium' ELSE 'none' END AS severity,
  CASE WHEN d.comment_id % 3 = 0 THEN 'open_source' ELSE 'synthetic' END AS source_type,
  CASE WHEN d.comment_id % 6 = 0 THEN 'documents' ELSE '' END AS source_dataset,
  CASE WHEN d.comment_id % 3 = 0 THEN 'table:' || source ELSE '' END AS source_url,
  CASE WHEN d.comment_id % 9 = 0 THEN '' ELSE 'CC0' END AS source_license,
  d.comment_id % 3 <> 0 AS is_transformed
FROM ({DOCS}) d LEFT JOIN labels l ON d.comment_id = l.doc_id"""
ORACLES["t23_labels_multi"] = f"""WITH e AS (SELECT comment_id, CASE WHEN comment_id % 5 = 0 THEN '{{not json'
  WHEN comment_id % 5 = 1 THEN '{{"a": 1}}' ELSE labels_multi END AS labels_multi FROM ({EXAMPLE_SOURCES}))
SELECT comment_id, labels_multi, json_valid(labels_multi) AS is_json,
  CASE WHEN json_valid(labels_multi) THEN json_type(labels_multi) = 'ARRAY' ELSE false END AS is_list,
  CASE WHEN json_valid(labels_multi) THEN json_extract_string(labels_multi, '$[1]') END AS second_label FROM e"""

# --- Matching ----------------------------------------------------------------

_KEYED = f"SELECT src || '-' || id || '-' || part AS comment_id, src, text FROM ({TEXTS})"
_MATCHED = f"WITH src AS ({_KEYED}),\n{norm_ctes('SELECT text FROM src')},\n{hits_ctes()}"
_ALL_HITS = "allhits AS (SELECT comment_id, list, phrase FROM src JOIN hits USING (text))"
ORACLES["m01_lexicon_buckets"] = f"""{_MATCHED},
b AS (SELECT list, first, count(*) FILTER (is_phrase) AS n_phrases FROM lex GROUP BY ALL),
t AS (SELECT tok, count(*) AS c FROM src JOIN words USING (text) GROUP BY ALL)
SELECT list, first, n_phrases, c AS n_comments FROM b JOIN t ON tok = first"""
ORACLES["m02_match_lexicon_join"] = f"{_MATCHED}, {_ALL_HITS}\nSELECT list, phrase, count(*) AS n_comments FROM allhits GROUP BY ALL"
ORACLES["m02_match_lexicon_scan"] = ORACLES["m02_match_lexicon_join"]
ORACLES["m02_match_lexicon_expressions"] = f"""{_MATCHED}
SELECT src, {', '.join(f'count(*) FILTER ("{s}") AS {s if s != "user" else chr(34) + "user" + chr(34)}' for s in SIGNALS)}
FROM src JOIN sig USING (text) GROUP BY src"""
ORACLES["m03_matched_phrases"] = f"""{_MATCHED},
m AS (SELECT text, array_to_string(list_sort(list(list || ':' || phrase)), '|') AS matched FROM hits
  WHERE list IN {qlist(MATCHERS)} GROUP BY text)
SELECT comment_id, coalesce(matched, '') AS matched FROM src LEFT JOIN m USING (text)"""
ORACLES["m04_contains_any"] = f"{_MATCHED}\nSELECT comment_id, hate_word, fan_word FROM src JOIN sig USING (text)"
ORACLES["m05_has_mention"] = f"{_MATCHED}\nSELECT comment_id, has_mention FROM src JOIN sig USING (text)"
ORACLES["m06_lexicon_signals"] = f"{_MATCHED}\nSELECT comment_id, {', '.join(MATCHERS)} FROM src JOIN sig USING (text)"
ORACLES["s05_lexicon_usage"] = f"""{_MATCHED}, {_ALL_HITS}
SELECT lex.list, lex.phrase, count(allhits.comment_id) AS n FROM lex
LEFT JOIN allhits ON lex.list = allhits.list AND lex.phrase = allhits.phrase GROUP BY ALL"""
ORACLES["m07_detect_target"] = decided(EVENTS, "SELECT target, context_type, count(*) AS n FROM d GROUP BY ALL")
ORACLES["m08_heuristic_toxicity"] = decided(EVENTS, "SELECT comment_id, htox AS toxicity FROM d")
ORACLES["m09_sentiment"] = f"""{_MATCHED},
b AS (SELECT comment_id, {count_terms(fv.NEGATIVE_TERMS)} - {count_terms(fv.POSITIVE_TERMS)} AS b FROM src JOIN norm USING (text))
SELECT comment_id, CASE WHEN b > 0 THEN 'negative' WHEN b < 0 THEN 'positive' ELSE 'neutral' END AS label,
  round(1e0 / (1e0 + exp(-CAST(b AS DOUBLE))), 3) AS score FROM b"""
_MODEL = """CASE WHEN length(nt) > 60 THEN 'negative' WHEN length(nt) < 20 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
  CAST(format('{:.4f}', CAST(length(nt) AS DOUBLE) / (length(nt) + 100)) AS DOUBLE) AS sentiment_score, 'model' AS sentiment_source"""
ORACLES["m10_score_sentiment_model"] = f"{_MATCHED}\nSELECT comment_id, {_MODEL} FROM src JOIN norm USING (text)"
ORACLES["x07_micro_batches"] = f"""{_MATCHED}, m AS (SELECT {_MODEL} FROM src JOIN norm USING (text))
SELECT sentiment_label, sentiment_source, count(*) AS n, round(sum(sentiment_score), 3) AS score_sum FROM m GROUP BY ALL"""
ORACLES["m10_model_label_map"] = """SELECT CASE WHEN event_id % 10 < 4 THEN 'positive' WHEN event_id % 10 < 8 THEN 'negative' ELSE 'neutral' END AS label,
  count(*) AS n FROM events GROUP BY ALL"""
ORACLES["m11_toxicity_from_label"] = """SELECT event_id, round(CASE WHEN event_id % 4 = 3 THEN 1e0 - value / (value + 100) ELSE value / (value + 100) END, 6) AS toxicity
FROM events"""
_NAN_DOCS = f"SELECT * REPLACE (CASE WHEN comment_id % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE given END AS given) FROM ({DOCS})"
ORACLES["m12_model_score"] = decided(_NAN_DOCS, "SELECT comment_id, model_toxicity_score, heuristic_toxicity_score FROM d")
ORACLES["m13_rating_disagreement"] = f"""SELECT comment_id, CASE WHEN rating = 'Skip' AND perf >= 80 THEN 0.25e0
  WHEN rating = 'Perfection' AND skip >= 35 THEN 0.15e0 ELSE 0e0 END AS disagreement FROM ({DOCS})"""
ORACLES["m14_risk_score"] = decided(DOCS, "SELECT comment_id, risk_score FROM d")
ORACLES["m15_decide_action"] = decided(EVENTS, """SELECT predicted_action, predicted_category, predicted_intent, predicted_severity,
  target_detected_pred, count(*) AS n FROM d GROUP BY ALL""")
ORACLES["m16_reason_codes"] = decided(EVENTS, "SELECT comment_id, reason_codes FROM d")
ORACLES["m17_explain"] = decided(EVENTS, "SELECT predicted_action, reason, count(*) AS n FROM d GROUP BY ALL")
ORACLES["m18_is_clean"] = decided(DOCS, """SELECT comment_id, risk < 0.1 AND model_toxicity_score < 0.1 AND predicted_action = 'allow'
  AND NOT (threat OR severe OR soft OR protected_abuse OR directed_attack) AS is_clean FROM d""")

_RULE_SOURCES = """SELECT CAST(conv_id AS VARCHAR) AS id, max(text) FILTER (turn = 0) AS description,
  list(text ORDER BY turn) FILTER (turn > 0 AND role = 'user') AS examples FROM conversations GROUP BY conv_id"""
_RULE_TEXT = """CASE WHEN len(coalesce(examples, [])) > 0 THEN description || chr(10) || 'Examples:' || chr(10) ||
  array_to_string(list_transform(examples, lambda e: '- ' || e), chr(10)) ELSE description END AS document"""
ORACLES["m19_rule_embedding_text"] = f"SELECT id, {_RULE_TEXT} FROM ({_RULE_SOURCES})"
ORACLES["s14_build_rule_index"] = f"""SELECT id, {_RULE_TEXT}, 'flag_for_review' AS action, 'harassment' AS category, 'medium' AS severity,
  len(embedding) AS n_dims, len(coalesce(examples, [])) AS n_examples
FROM ({_RULE_SOURCES}) r JOIN embeddings e ON r.id = CAST(e.vec_id AS VARCHAR)"""
_CLASS_RULES = f"""p AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
means AS (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM p GROUP BY ALL),
rules AS (SELECT label, 'rule_' || label AS id, list(x ORDER BY pos) AS v, {pick(fv.ACTIONS, 'label % 3')} AS action,
  'category_' || label AS category, {pick(fv.SEVERITIES, 'label % 5')} AS severity FROM means GROUP BY label)"""
_DIST = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
ORACLES["m20_retrieve_rules"] = f"""WITH {_CLASS_RULES},
x AS (SELECT vec_id, id, {_DIST.format(a='e.embedding', b='v')} AS distance FROM embeddings e, rules),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) AS rank FROM x)
SELECT vec_id AS comment_id, CAST(rank AS INT) AS rank, id AS rule_id, round(distance, 5) AS distance FROM r
WHERE rank <= 3 AND distance <= 1.2"""
ORACLES["m20_nearest_in_table"] = f"""WITH x AS (SELECT q.vec_id, 'rule_' || r.vec_id AS id, {_DIST.format(a='q.embedding', b='CAST(r.embedding AS DOUBLE[])')} AS distance
  FROM embeddings q, embeddings r),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) AS rank FROM x)
SELECT vec_id AS comment_id, CAST(rank AS INT) AS rank, id AS rule_id, round(distance, 5) AS distance FROM r WHERE rank <= 3 AND distance <= 1.9"""
ORACLES["m21_rule_override"] = f"""WITH {_CLASS_RULES}, {decision_ctes(DOCS)},
x AS (SELECT vec_id, r.*, {_DIST.format(a='e.embedding', b='v')} AS distance FROM embeddings e, rules r),
top AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) = 1),
j AS (SELECT d.*, t.id AS rid, t.action AS ra, t.category AS rc, t.severity AS rs FROM d LEFT JOIN top t
  ON d.comment_id = t.vec_id AND t.distance <= 1.1 AND NOT (d.risk < 0.1 AND d.model < 0.1 AND d.predicted_action = 'allow'
  AND NOT (threat OR severe OR soft OR protected_abuse OR directed_attack)))
SELECT comment_id,
  CASE WHEN ra <> 'allow' AND predicted_action = 'allow' AND model > 0.75 THEN ra ELSE predicted_action END AS predicted_action,
  CASE WHEN ra <> 'allow' AND (predicted_action <> 'allow' OR model > 0.75) THEN rc ELSE predicted_category END AS predicted_category,
  CASE WHEN ra <> 'allow' THEN rs ELSE predicted_severity END AS predicted_severity,
  coalesce(rid, '') AS triggered_rules FROM j"""
ORACLES["m22_failure_rows"] = decided(EVENTS, """, f AS (SELECT *, CASE event_type WHEN 'signup' THEN 'language'
  WHEN 'view' THEN 'ml_toxicity' WHEN 'error' THEN 'context' END AS stage FROM d)
SELECT CASE WHEN stage IS NULL THEN predicted_action ELSE 'flag_for_review' END AS predicted_action,
  CASE WHEN stage IS NULL THEN predicted_category ELSE 'pipeline_error' END AS predicted_category,
  CASE WHEN stage IS NULL THEN reason_codes ELSE 'PIPELINE_ERROR' END AS codes,
  CASE WHEN stage IS NULL THEN reason ELSE 'Pipeline failed at ' || stage || ' — defaulting to review' END AS reason,
  count(*) AS n, round(sum(CASE WHEN stage IS NULL THEN risk_score ELSE 0e0 END), 3) AS risk
FROM f GROUP BY 1, 2, 3, 4""")
_ODD = f"""SELECT comment_id, text, source, CASE WHEN comment_id % 13 = 0 THEN 120 ELSE perf END AS perf,
  CASE WHEN comment_id % 17 = 0 THEN -1 ELSE skip END AS skip, CASE WHEN comment_id % 19 = 0 THEN 1.5 ELSE given END AS given FROM ({DOCS})"""
_REASONS = """list_filter([CASE WHEN coalesce(length(text), 0) < 1 THEN 'text_empty' END, CASE WHEN length(text) > 2000 THEN 'text_too_long' END,
  CASE WHEN NOT perf BETWEEN 0 AND 100 THEN 'perfection_pct_out_of_range' END,
  CASE WHEN NOT skip BETWEEN 0 AND 100 THEN 'skip_pct_out_of_range' END,
  CASE WHEN given IS NOT NULL AND NOT given BETWEEN 0 AND 1 THEN 'model_score_out_of_range' END], lambda x: x IS NOT NULL)"""
ORACLES["m23_validate_requests"] = f"SELECT comment_id, array_to_string({_REASONS}, '|') AS reasons FROM ({_ODD})"
ORACLES["m23_validate_batches"] = f"""WITH s AS (SELECT source, count(*) * 5 AS n_rows FROM documents GROUP BY 1)
SELECT source, n_rows > 256 AS batch_too_large, count(*) AS n FROM ({_ODD}) JOIN s USING (source)
WHERE n_rows > 256 OR len({_REASONS}) > 0 GROUP BY ALL"""
ORACLES["m24_moderate_documents"] = decided(DOCS, f"SELECT comment_id, {DECISION} FROM d")
ORACLES["m24_moderate_conversations"] = decided(CONV, f"SELECT conv_id, turn, {DECISION} FROM d")
for _name in ("m24_moderate_events", "j05_moderate_distinct", "x01_moderate_stream"):
    ORACLES[_name] = decided(EVENTS, f"SELECT comment_id, {DECISION} FROM d")
ORACLES["m25_moderate_v1_documents"] = decided(DOCS, f"SELECT comment_id, {DECISION} FROM d", v1=True)
ORACLES["m25_moderate_v1_events"] = decided(EVENTS, f"SELECT comment_id, {DECISION} FROM d", v1=True)
ORACLES["m26_risk_band_counts"] = decided(DOCS, """SELECT CASE WHEN risk_score > 0.65 THEN 'high' WHEN risk_score > 0.35 THEN 'medium' ELSE 'low' END AS risk_band,
  count(*) AS n_comments FROM d GROUP BY ALL""")

# --- Evaluation --------------------------------------------------------------

ORACLES["a01_prepare_eval"] = f"""WITH r AS (SELECT d.*, CASE WHEN d.comment_id % 11 = 0 THEN 'unsure'
    WHEN l.doc_id IS NULL THEN '' ELSE {TRUE_ACTION} END AS moderation_action
  FROM ({DOCS}) d LEFT JOIN labels l ON d.comment_id = l.doc_id)
SELECT comment_id, moderation_action,
  CASE WHEN comment_id % 3 = 0 THEN 90e0 ELSE perf END AS movie_rating_perfection_pct,
  CASE WHEN comment_id % 4 = 0 THEN 5e0 ELSE skip END AS movie_rating_skip_pct,
  CASE WHEN comment_id % 7 = 0 THEN 'unknown' ELSE lang END AS language_mix,
  NOT (moderation_action IN {qlist(fv.ACTIONS)} AND trim(text, {paren(' ' + chr(9) + chr(10) + chr(13))}) <> '') AS skipped,
  md5(trim(text, {paren(' ' + chr(9) + chr(10) + chr(13))})) AS text_md5 FROM r"""
_GRID = f"grid AS (SELECT a AS actual, p AS predicted FROM (VALUES ('allow'), ('flag_for_review'), ('flag_for_removal')) x(a), (VALUES ('allow'), ('flag_for_review'), ('flag_for_removal')) y(p))"
_PER_LABEL = """pl AS (SELECT label, count(*) FILTER (a = label AND p = label) AS tp, count(*) FILTER (a <> label AND p = label) AS fp,
  count(*) FILTER (a = label AND p <> label) AS fn FROM ap, (VALUES {labels}) v(label) GROUP BY label),
pr AS (SELECT label, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0e0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0e0 END AS recall FROM pl),
cm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pr)"""
_AP = ", ap AS (SELECT lang, moderation_action AS a, predicted_action AS p FROM d)"
_CM = _AP + ",\n" + _PER_LABEL.format(labels=", ".join(f"('{a}')" for a in fv.ACTIONS))
_METRIC = "label, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"
ORACLES["a02_confusion_matrix"] = decided(LABELLED, "SELECT actual, predicted, count(ap.a) AS n FROM grid LEFT JOIN ap ON a = actual AND p = predicted GROUP BY ALL", f"{_AP}, {_GRID}")
ORACLES["a03_class_metrics"] = decided(LABELLED, f"SELECT {_METRIC} FROM cm", _CM)
ORACLES["a04_accuracy"] = decided(LABELLED, "SELECT count(*) AS total, round(avg(CASE WHEN a = p THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM ap", _AP)
ORACLES["a05_macro_weighted_f1"] = decided(LABELLED, """SELECT round(avg(f1) FILTER (support > 0), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM cm""", _CM)
ORACLES["a06_naive_baseline"] = decided(LABELLED, """SELECT label AS majority_label, round(support / (SELECT sum(support) FROM cm)::DOUBLE, 9) AS baseline_accuracy
FROM cm ORDER BY support DESC, list_position(['allow', 'flag_for_review', 'flag_for_removal'], label) LIMIT 1""", _CM)
_BY_LANG = """, bl AS (SELECT lang, label, count(*) FILTER (a = label AND p = label) AS tp, count(*) FILTER (a <> label AND p = label) AS fp,
  count(*) FILTER (a = label AND p <> label) AS fn FROM ap, (VALUES ('allow'), ('flag_for_review'), ('flag_for_removal')) v(label) GROUP BY ALL),
bf AS (SELECT *, CASE WHEN tp > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1 FROM bl)"""
ORACLES["a07_metrics_by_language"] = decided(LABELLED, f"""SELECT lang, CAST(sum(tp + fn) AS BIGINT) AS count,
  {round_to('sum(tp)::DOUBLE / sum(tp + fn)::DOUBLE', 4)} AS accuracy, {round_to('avg(f1) FILTER (tp + fn > 0)', 4)} AS macro_f1 FROM bf GROUP BY lang""", _AP + _BY_LANG)
_BIN = ", ap AS (SELECT CASE WHEN moderation_action = 'allow' THEN 'safe' ELSE 'unsafe' END AS a, CASE WHEN predicted_action = 'allow' THEN 'safe' ELSE 'unsafe' END AS p FROM d),\n"
ORACLES["a08_binary_report"] = decided(LABELLED, f"SELECT {_METRIC} FROM cm", _BIN + _PER_LABEL.format(labels="('safe'), ('unsafe')"))
_SLICE = f", x AS (SELECT d.predicted_action, e.labels_multi, e.target_detected FROM d JOIN ({EXAMPLE_SOURCES}) e USING (comment_id))"
_RATE = "SELECT count(*) AS n_rows, round(avg(CASE WHEN predicted_action <> 'allow' THEN 1e0 ELSE 0e0 END), 9) AS flag_rate FROM x WHERE "
ORACLES["a09_false_positives_on_criticism"] = decided(DOCS, _RATE + "labels_multi LIKE '%harsh_criticism%' OR labels_multi LIKE '%actor_work_criticism%'", _SLICE)
ORACLES["a10_catch_rate_on_people"] = decided(DOCS, _RATE + f"target_detected IN {PEOPLE}", _SLICE)
ORACLES["j03_attach_predictions"] = decided(LABELLED, "SELECT comment_id, moderation_action, predicted_action, risk_score FROM d")
ORACLES["s13_eval_report"] = decided(LABELLED, f"""SELECT (SELECT count(*) FROM ap) AS total,
  {round_to("(SELECT avg(CASE WHEN a = p THEN 1e0 ELSE 0e0 END) FROM ap)", 4)} AS accuracy,
  {round_to("(SELECT avg(f1) FROM cm WHERE support > 0)", 4)} AS macro_f1,
  {round_to("(SELECT sum(f1 * support) / sum(support) FROM cm)", 4)} AS weighted_f1, 'documents' AS dataset_path,
  CAST(3 AS BIGINT) AS n_classes, (SELECT count(DISTINCT lang) FROM ap) AS n_languages""", _CM)

# --- Quality and dataset -----------------------------------------------------

ORACLES["a11_value_counts"] = """SELECT 'lang' AS dimension, lang AS value, count(*) AS count FROM documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL"""
LANG_MIX = (
    f"CASE WHEN list_has_any(regexp_extract_all(lower(text), '[a-z0-9-]+'), [{', '.join(q(t) for t in fv.HINGLISH_TOKENS)}]) "
    "THEN 'hinglish_latin' ELSE 'english' END"
)
EXAMPLES = f"SELECT * REPLACE ({redact('text')} AS text) FROM ({EXAMPLE_SOURCES})"
EXAMPLES_MIX = f"SELECT *, {LANG_MIX} AS language_mix, 'train' AS split FROM ({EXAMPLES})"
ORACLES["a12_class_distribution"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS count FROM ex GROUP BY ALL"
    for c in ["moderation_action", "label_primary", "abuse_category", "source_type", "split", "language_mix"]
)
ORACLES["a12_class_distribution"] = f"WITH ex AS ({EXAMPLES_MIX})\n" + ORACLES["a12_class_distribution"]
ORACLES["a13_duplicate_texts"] = "SELECT md5(text) AS text_md5, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1"
ORACLES["a13_duplicate_count"] = "SELECT count(*) AS n_duplicate_texts FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"
ORACLES["a14_validate_examples"] = f"""WITH r AS (SELECT comment_id AS row_key, text, source_type, source_dataset, source_url, source_license,
  'ex_' || (comment_id // 3 * 3) AS example_id,
  CASE WHEN comment_id % 10 = 0 THEN '' ELSE 'train' END AS split,
  CASE WHEN comment_id % 8 = 0 THEN 'severe' ELSE severity END AS severity,
  CASE WHEN comment_id % 9 = 0 THEN '{{"a": 1}}' WHEN comment_id % 9 = 1 THEN '[oops' ELSE labels_multi END AS labels_multi
  FROM ({EXAMPLE_SOURCES}))
SELECT row_key, 'missing split' AS "check", '' AS detail FROM r WHERE split = ''
UNION ALL SELECT row_key, 'missing text', '' FROM r WHERE text = ''
UNION ALL SELECT row_key, 'invalid split', split FROM r WHERE split NOT IN {qlist(fv.SPLITS)}
UNION ALL SELECT row_key, 'invalid severity', severity FROM r WHERE severity NOT IN {qlist(fv.SEVERITIES)}
UNION ALL SELECT row_key, 'labels_multi must be a JSON list', '' FROM r WHERE row_key % 9 = 0
UNION ALL SELECT row_key, 'labels_multi is not valid JSON', '' FROM r WHERE row_key % 9 = 1
UNION ALL SELECT row_key, 'possible email in text', '' FROM r WHERE {EMAIL}
UNION ALL SELECT row_key, 'possible phone number in text', '' FROM r WHERE {PHONE}
UNION ALL SELECT row_key, 'open_source row missing source_dataset', '' FROM r WHERE source_type = 'open_source' AND source_dataset = ''
UNION ALL SELECT row_key, 'open_source row missing source_url', '' FROM r WHERE source_type = 'open_source' AND source_url = ''
UNION ALL SELECT row_key, 'open_source row missing source_license', '' FROM r WHERE source_type = 'open_source' AND source_license = ''
UNION ALL (SELECT row_key, 'duplicate example_id', example_id FROM r QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY row_key) > 1)
UNION ALL SELECT NULL, 'duplicate text values', CAST(n AS VARCHAR) FROM
  (SELECT count(*) AS n FROM (SELECT text FROM r GROUP BY text HAVING count(*) > 1)) WHERE n > 0
UNION ALL SELECT NULL, 'unexpected row count', CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM r) WHERE n <> 500"""
_PROFANE = f"list_has_any(regexp_extract_all(lower(text), '[a-z0-9-]+'), [{', '.join(q(t) for t in fv.EXAMPLE_PROFANITY)}])"
ORACLES["d01_derive_example_fields"] = f"""SELECT comment_id, text, CAST(contains(text, '@') AS VARCHAR) AS has_mention, {LANG_MIX} AS language_mix,
  labels_multi, CAST({_PROFANE} AS VARCHAR) AS contains_profanity, CAST(target_detected IN {PEOPLE} AS VARCHAR) AS is_directed_at_person,
  CAST(is_transformed AS VARCHAR) AS is_transformed, CASE WHEN is_transformed THEN 'context_rewritten' ELSE '' END AS transformation_type
FROM ({EXAMPLES})"""
ORACLES["d02_rationale"] = f"""SELECT moderation_action, target_detected, CASE moderation_action
  WHEN 'allow' THEN {q(fv.RATIONALES['allow_craft'])} WHEN 'flag_for_review' THEN {q(fv.RATIONALES['flag_for_review'])}
  ELSE {q(fv.RATIONALES['flag_for_removal'])} END AS rationale_short, count(*) AS n FROM ({EXAMPLE_SOURCES}) GROUP BY ALL"""
TOXIC = """SELECT doc_id AS comment_id, text, coalesce(l.toxic, 0) AS toxic, contains(lower(text), 'moron') AS severe_toxic,
  contains(lower(text), 'trash') AS obscene, contains(lower(text), 'loser') AS threat, contains(lower(text), 'idiot') AS insult,
  contains(lower(text), 'clown') AS identity_hate FROM documents LEFT JOIN labels l USING (doc_id)"""
_ANY_TOXIC = "(toxic = 1 OR severe_toxic OR obscene OR threat OR insult OR identity_hate)"
ORACLES["d03_map_toxicity_labels"] = f"""SELECT comment_id, CASE WHEN {_ANY_TOXIC} THEN 'flag_for_review' ELSE 'allow' END AS moderation_action,
  CASE WHEN {_ANY_TOXIC} THEN 'unsafe' ELSE 'safe' END AS label_primary,
  CASE WHEN {_ANY_TOXIC} THEN '["unsafe","open_source_toxicity"]' ELSE '["safe","open_source_non_toxic"]' END AS labels_multi,
  CASE WHEN NOT {_ANY_TOXIC} THEN 'non_abusive' WHEN threat THEN 'threat_or_violence' WHEN identity_hate THEN 'hate_or_identity_attack'
    WHEN insult THEN 'personal_attack' WHEN obscene THEN 'profanity' ELSE 'harassment' END AS abuse_category,
  CASE WHEN {_ANY_TOXIC} THEN 'insult' ELSE 'normal_discussion' END AS intent_label,
  CASE WHEN NOT {_ANY_TOXIC} THEN 'none' WHEN severe_toxic OR threat THEN 'high' ELSE 'medium' END AS severity FROM ({TOXIC})"""
_NO_MARKS = " AND ".join(f"NOT contains(lower(t), {q(m)})" for m in fv.OPEN_SOURCE_MARKERS)
ORACLES["d04_balanced_sample"] = f"""WITH c AS (SELECT comment_id, {redact('text')} AS t, {_ANY_TOXIC} AS bad FROM ({TOXIC}))
SELECT comment_id, t AS text, CASE WHEN bad THEN 'flag_for_review' ELSE 'allow' END AS moderation_action FROM c
WHERE length(t) BETWEEN 25 AND 220 AND {_NO_MARKS}
QUALIFY row_number() OVER (PARTITION BY bad ORDER BY md5('42:' || comment_id), comment_id) <= 15"""
ORACLES["d05_stratified_split"] = f"""WITH g AS (SELECT comment_id, scenario_id,
  row_number() OVER (PARTITION BY split_part(scenario_id, '_', 1) ORDER BY md5('42:' || comment_id), comment_id) AS r,
  count(*) OVER (PARTITION BY split_part(scenario_id, '_', 1)) AS n FROM ({EXAMPLE_SOURCES}))
SELECT comment_id, scenario_id, CASE WHEN r <= round_even(n * 0.7e0, 0) THEN 'train'
  WHEN r <= round_even(n * 0.7e0, 0) + round_even(n * 0.2e0, 0) THEN 'test' ELSE 'eval' END AS split FROM g"""
ORACLES["d06_assign_ids"] = """SELECT doc_id AS comment_id, printf('example_%04d', row_number() OVER (ORDER BY doc_id)) AS example_id FROM documents"""
# A text that another row has already, as given or settled in an earlier round, moves on to another number, as often as it takes.
_NUMBERED = f"""left(text, CAST({fv.TEXT_CAP} - length(suffix) AS BIGINT)) || suffix"""
_SUFFIX = f"""' ' || [{', '.join(q(s) for s in fv.UNIQUE_SUFFIXES)}][(2 * k - 1) % 10 + 1] || ' Case ' || (2 * k + moved) || '.'"""
ORACLES["d07_uniquify_text"] = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT comment_id, text, row_number() OVER (PARTITION BY text ORDER BY comment_id) - 1 AS k FROM ({EXAMPLES})),
given AS MATERIALIZED (SELECT DISTINCT text AS made FROM c WHERE text IS NOT NULL),
m AS (SELECT 0 AS round, comment_id, text, k, moved, {_NUMBERED} AS made, false AS settled
    FROM (SELECT *, {_SUFFIX} AS suffix FROM (SELECT *, CAST(0 AS BIGINT) AS moved FROM c WHERE k > 0 AND text IS NOT NULL))
  UNION ALL SELECT round + 1, comment_id, text, k, moved, {_NUMBERED}, settled
    FROM (SELECT *, {_SUFFIX} AS suffix FROM (SELECT round, comment_id, text, k, moved + turn * 1000003 AS moved, turn = 0 AS settled
      FROM (SELECT *, CASE WHEN settled THEN 0 ELSE row_number() OVER (PARTITION BY made, settled ORDER BY comment_id) - 1 + CASE WHEN held THEN 1 ELSE 0 END END AS turn
        FROM (SELECT m.*, bool_or(m.settled) OVER (PARTITION BY m.made) OR given.made IS NOT NULL AS held, bool_or(NOT m.settled) OVER () AS going
          FROM m LEFT JOIN given ON m.made = given.made)
        WHERE going))))
SELECT comment_id, text FROM c WHERE k = 0 OR text IS NULL
UNION ALL SELECT comment_id, made FROM m WHERE round = (SELECT max(round) FROM m)"""


def keyword(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + ")"


ORACLES["d08_keyword_label"] = f"""SELECT src, id, part, CASE WHEN {keyword(fv.GROUP_FLAG_KEYWORDS)} THEN 'flag_for_review' ELSE 'allow' END AS group_action,
  CASE WHEN {keyword(fv.PROTECTED_FLAG_KEYWORDS)} THEN 'flag_for_removal' ELSE 'allow' END AS protected_action FROM ({TEXTS})"""
ORACLES["d09_limit_rows"] = f"SELECT comment_id, scenario_id FROM ({EXAMPLE_SOURCES}) ORDER BY comment_id LIMIT 500"
FEED = "SELECT conv_id, turn, text, 'reply_to_comment' AS context_type, 'Timepass' AS rating, 50e0 AS perf, 20e0 AS skip, CAST(NULL AS DOUBLE) AS given FROM conversations"
ORACLES["d10_default_context"] = decided(FEED, f"SELECT conv_id, turn, {DECISION} FROM d")
ORACLES["d11_replicate"] = f"""SELECT CAST(copy AS INT) AS copy, context_type, count(*) AS n, count(DISTINCT comment_id) AS n_ids
FROM ({EVENTS}), range(5) r(copy) GROUP BY ALL"""

# --- Operations --------------------------------------------------------------

ORACLES["a15_decision_counts"] = decided(EVENTS, "SELECT predicted_action AS action, predicted_category AS category, count(*) AS n FROM d GROUP BY ALL")
ORACLES["a16_latency_histogram"] = "\nUNION ALL ".join(
    f"SELECT '{b}' AS le, count(*) FILTER (value / 100e0 <= {dbl(b)}) AS n FROM events" for b in fv.LATENCY_BUCKETS
) + "\nUNION ALL SELECT '+Inf', count(*) FROM events"
ORACLES["a17_ops_summary"] = decided(EVENTS, "SELECT count(*) AS n_requests, " + ", ".join(
    f"round(quantile_cont(latency_s, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
) + ", " + ", ".join(f"round(avg(CASE WHEN predicted_action = '{a}' THEN 1e0 ELSE 0e0 END), 6) AS {a}_rate" for a in fv.ACTIONS)
    + ", round(avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END), 6) AS model_call_rate FROM d")
ORACLES["a17_latency_rollup"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_requests, true AS p50_right, true AS p95_right, true AS p99_right
FROM events GROUP BY ALL"""
ORACLES["a18_error_counts"] = "SELECT CASE WHEN event_type = 'error' THEN 'context' ELSE 'none' END AS error_type, count(*) AS n FROM events GROUP BY ALL"
_CACHE = f"""WITH RECURSIVE e AS (SELECT sha256(text || ':' || context_type) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM ({EVENTS})),
m(k, s) AS (SELECT k, min(s) FROM e GROUP BY k
  UNION ALL SELECT m.k, min(e.s) FROM m JOIN e ON e.k = m.k AND e.s >= m.s + {fv.CACHE_TTL_SECONDS} GROUP BY m.k),
c AS (SELECT k, count(*) AS misses FROM m GROUP BY k), r AS (SELECT k, count(*) AS requests FROM e GROUP BY k)"""
ORACLES["a19_cache_hits"] = f"{_CACHE}\nSELECT k AS cache_key, requests, misses, requests - misses AS hits FROM c JOIN r USING (k)"
_WEEK = _CACHE.replace(str(fv.CACHE_TTL_SECONDS), str(7 * 86_400))
ORACLES["a19_cache_hits_week"] = f"{_WEEK}\nSELECT k AS cache_key, requests, misses, requests - misses AS hits FROM c JOIN r USING (k)"
# The rows that a cache would miss: of the second of each write, the event with the smallest id.
for _name, _misses in (("x03_dedupe_stream", _CACHE), ("x03_dedupe_stream_week", _WEEK)):
    ORACLES[_name] = f"""{_misses}
SELECT m.k AS cache_key, min(t.comment_id) AS comment_id FROM m
JOIN (SELECT sha256(text || ':' || context_type) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, comment_id FROM ({EVENTS})) t ON t.k = m.k AND t.s = m.s
GROUP BY m.k, m.s"""
ORACLES["a19_cache_summary"] = f"""{_CACHE}
SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(requests - misses) AS BIGINT) AS hits,
  round(sum(requests - misses) / sum(requests)::DOUBLE, 9) AS hit_rate FROM c JOIN r USING (k)"""
ORACLES["a20_action_summary"] = decided(EVENTS, "SELECT predicted_action, count(*) AS n FROM d GROUP BY ALL")
_TRAIN = f"""WITH lab AS ({decided(EVENTS, 'SELECT comment_id, predicted_action AS moderation_action FROM d', v1=True)}),
train AS (SELECT 'doc' AS src, comment_id, text, context_type, rating, perf, skip, given, moderation_action FROM ({LABELLED})
  UNION ALL SELECT 'event', e.comment_id, text, context_type, rating, perf, skip, given, lab.moderation_action FROM ({EVENTS}) e JOIN lab USING (comment_id)),
feat AS (WITH {decision_ctes('SELECT * FROM train')} SELECT src, comment_id, CASE WHEN {REPLY} THEN 1e0 ELSE 0e0 END AS is_reply,
  CASE WHEN has_mention THEN 1e0 ELSE 0e0 END AS has_mention, CASE WHEN negative THEN 1e0 ELSE 0e0 END AS is_negative, htox,
  CASE WHEN moderation_action <> 'allow' THEN 1e0 ELSE 0e0 END AS flagged FROM d)"""
ORACLES["a22_risk_features"] = f"{_TRAIN}\nSELECT src, comment_id, is_reply, has_mention, is_negative, htox, flagged FROM feat"
ORACLES["a21_fit_risk_weights"] = _TRAIN.replace("WITH lab", "WITH RECURSIVE lab", 1) + f""",
g AS (SELECT is_reply AS x0, has_mention AS x1, is_negative AS x2, htox AS x3, flagged AS y, count(*)::DOUBLE AS n FROM feat GROUP BY ALL),
gd(i, w0, w1, w2, w3, b) AS (SELECT 0, 0e0, 0e0, 0e0, 0e0, 0e0
  UNION ALL SELECT i + 1, w0 - 0.1e0 * sum(n * er * x0) / sum(n), w1 - 0.1e0 * sum(n * er * x1) / sum(n), w2 - 0.1e0 * sum(n * er * x2) / sum(n),
    w3 - 0.1e0 * sum(n * er * x3) / sum(n), b - 0.1e0 * sum(n * er) / sum(n)
  FROM (SELECT gd.*, g.*, 1e0 / (1e0 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + b))) - y AS er FROM gd, g WHERE i < 200)
  GROUP BY i, w0, w1, w2, w3, b),
w AS (SELECT unnest(['reply_context_base', 'has_mention', 'negative_sentiment', 'toxicity_scale']) AS weight,
  unnest([w0, w1, w2, w3]) AS x, unnest([0.05, 0.05, 0.05, 0.30])::DOUBLE AS lo, unnest([0.40, 0.30, 0.30, 0.65])::DOUBLE AS hi FROM gd WHERE i = 200)
SELECT weight, round(x, 6) AS fitted, {round_to('greatest(lo, least(hi, x))', 4)} AS clamped FROM w"""
_FEEDBACK = f""", fbk AS (SELECT sha256(text) AS h, moderation_action AS human_action, 'm' || quality AS moderator_id, comment_id AS t FROM ({LABELLED})),
latest AS (SELECT * FROM fbk QUALIFY row_number() OVER (PARTITION BY h ORDER BY t DESC, moderator_id DESC) = 1),
jf AS (SELECT CAST(comment_id AS VARCHAR) AS request_id, predicted_action AS action, human_action, moderator_id
  FROM d JOIN latest ON sha256(text) = h WHERE predicted_action <> 'allow')"""
ORACLES["a23_feedback_disagreement"] = decided(DOCS, "SELECT action AS decided, human_action AS human, count(*) AS n FROM jf GROUP BY ALL", _FEEDBACK)
ORACLES["a23_override_rate"] = decided(DOCS, """SELECT count(*) AS n_reviewed, count(*) FILTER (action <> human_action) AS n_overridden,
  round(count(*) FILTER (action <> human_action) / count(*)::DOUBLE, 9) AS override_rate FROM jf""", _FEEDBACK)
ORACLES["j04_feedback_join"] = decided(DOCS, "SELECT request_id, action, human_action, moderator_id FROM jf", _FEEDBACK)
ORACLES["r01_review_queue"] = decided(DOCS, """SELECT comment_id, predicted_action, risk_score FROM d WHERE predicted_action <> 'allow'
ORDER BY predicted_action DESC, risk_score DESC, comment_id LIMIT 20""")
ORACLES["r02_top_risk"] = decided(DOCS, """SELECT comment_id, predicted_action, risk_score FROM d
ORDER BY predicted_action <> 'allow' DESC, risk_score DESC, comment_id LIMIT 50""")
ORACLES["r03_clean_feed"] = rf"""WITH t AS (SELECT conv_id * 1000 + turn AS position,
  CASE WHEN conv_id % 10 = 0 THEN '[deleted]' ELSE trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) END AS text FROM conversations)
SELECT position, left(text, 1000) AS text FROM (SELECT * FROM t WHERE text NOT IN ('', '[deleted]', '[removed]') AND length(text) >= 8
QUALIFY row_number() OVER (PARTITION BY text ORDER BY position) = 1)"""
ORACLES["r04_latest_review_items"] = decided(EVENTS, """SELECT comment_id, predicted_action FROM d WHERE predicted_action = 'flag_for_review'
ORDER BY ts DESC, comment_id DESC LIMIT 1000""")
ORACLES["r05_head_sample"] = "SELECT doc_id, CASE WHEN length(text) > 72 THEN left(text, 72) || '…' ELSE text END AS preview, lang FROM documents ORDER BY doc_id LIMIT 20"

# --- Sources and sinks -------------------------------------------------------

ORACLES["s01_read_examples_csv"] = f"SELECT CAST(comment_id AS VARCHAR) AS example_id, text, context_type, '' AS source_url FROM ({DOCS})"
for _name in ("s02_examples_parquet", "s03_write_examples_csv"):
    ORACLES[_name] = f"SELECT scenario_id, text, labels_multi, moderation_action FROM ({EXAMPLES})"
ORACLES["s04_policy_rules"] = decided(EVENTS, "SELECT id, action, category, severity, CAST(n_examples AS BIGINT) AS n_examples, count(d.comment_id) AS n_decisions FROM rules LEFT JOIN d ON category = predicted_category GROUP BY ALL",
    ", rules(id, action, category, severity, n_examples) AS (VALUES " + ", ".join(
        f"({q(r['id'])}, {q(r['action'])}, {q(r['category'])}, {q(r['severity'])}, {len(r['examples'])})" for r in fv.POLICY_RULES) + ")")
ORACLES["s06_weights"] = decided(EVENTS, "SELECT comment_id, predicted_action, risk_score FROM d",
    weights={"reply_context_base": 0.4, "main_review_base": 0.05, "has_mention": 0.15, "negative_sentiment": 0.15,
             "toxicity_scale": 0.45, "flag_for_review_risk": 0.58, "flag_for_review_model": 0.82})
ORACLES["s07_audit"] = decided(DOCS, """SELECT comment_id * 3600 AS epoch, CAST(comment_id AS VARCHAR) AS request_id, sha256(text) AS text_hash, context_type,
  predicted_action AS action, predicted_category AS category, predicted_severity AS severity, reason_codes, round(comment_id / 7e0, 2) AS latency_ms
FROM d WHERE predicted_action <> 'allow'""")
_FB_ROWS = f"""f AS (SELECT comment_id AS epoch, sha256(text) AS text_hash, moderation_action AS human_action, 'anonymous' AS moderator_id
  FROM ({LABELLED}) WHERE comment_id % 11 <> 0)"""
ORACLES["s08_feedback"] = f"WITH {_FB_ROWS} SELECT * FROM f UNION ALL SELECT * FROM f WHERE human_action = 'flag_for_removal'"
ORACLES["s09_export_csv"] = decided(FEED, """SELECT conv_id || '-' || turn AS source, length(text) AS score, text, predicted_action, target_detected_pred,
  predicted_category, predicted_severity, risk_score, reason_codes, reason FROM d""")
ORACLES["s10_flatten_threads"] = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text, turn AS score,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM conversations"""
ORACLES["s10_order_threads"] = """WITH RECURSIVE c AS (SELECT *, CASE WHEN turn > 0 THEN turn - 1 - (turn - 1) % 3 END AS parent FROM conversations),
w AS (SELECT conv_id, turn, [turn] AS path FROM c WHERE parent IS NULL
  UNION ALL SELECT c.conv_id, c.turn, list_append(w.path, c.turn) FROM w JOIN c ON c.conv_id = w.conv_id AND c.parent = w.turn)
SELECT conv_id, turn, parent, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position, len(path) - 1 AS depth, text
FROM w JOIN c USING (conv_id, turn)"""
ORACLES["s11_upsert_rules"] = """WITH r AS (SELECT source AS id, 'documents: ' || count(*) AS description FROM documents GROUP BY 1),
c AS (SELECT source AS id, 'toxic: ' || count(*) AS description FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT id, coalesce(c.description, r.description) AS description, CASE WHEN c.id IS NULL THEN 'allow' ELSE 'flag_for_review' END AS action, 'none' AS severity
FROM r LEFT JOIN c USING (id) UNION ALL SELECT lang, 'language: ' || count(*), 'allow', NULL FROM documents GROUP BY 1"""
ORACLES["s12_pii_scan"] = f"""WITH e AS ({EXAMPLES}), s AS (SELECT 'contains_pii_column' AS "check", CAST(0 AS BIGINT) AS n_rows
  UNION ALL SELECT 'email_regex', count(*) FILTER ({EMAIL}) FROM e UNION ALL SELECT 'phone_regex', count(*) FILTER ({PHONE}) FROM e)
SELECT "check", n_rows, CASE WHEN n_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM s"""

# --- Streams -----------------------------------------------------------------

ORACLES["x02_route_batches"] = decided(EVENTS, """SELECT 'decisions' AS sink, predicted_action AS action, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'audit', predicted_action, count(*) FROM d WHERE predicted_action <> 'allow' GROUP BY ALL
UNION ALL SELECT 'review', predicted_action, count(*) FROM d WHERE predicted_action = 'flag_for_review' GROUP BY ALL""")
ORACLES["x02_review_queue_state"] = ORACLES["r04_latest_review_items"]
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLES["x04_windowed_decisions"] = decided(EVENTS, f"""SELECT {_STAMP.format("date_trunc('hour', ts)")} AS start, predicted_action, count(*) AS n,
  round(sum(latency_s), 4) AS sum_latency_s, max(latency_s) AS max_latency_s FROM d GROUP BY ALL""")
_HALF = "time_bucket(INTERVAL 30 MINUTE, ts)"
ORACLES["x04_sliding_decisions"] = decided(EVENTS, f"""SELECT {_STAMP.format('s')} AS start, predicted_action, count(*) AS n FROM
  (SELECT predicted_action, {_HALF} AS s FROM d UNION ALL SELECT predicted_action, {_HALF} - INTERVAL 30 MINUTE FROM d) GROUP BY ALL""")
_MICROS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
ORACLES["x04_stream_windows"] = decided(EVENTS, f"""SELECT {_MICROS.format("date_trunc('hour', ts)")} AS start, predicted_action, count(*) AS n,
  round(sum(latency_s), 4) AS sum_latency_s, max(latency_s) AS max_latency_s FROM d
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK} GROUP BY ALL""")
for _name, _closed in (("x04_session_decisions", ""), ("x04_stream_sessions", f'HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}')):
    ORACLES[_name] = decided(EVENTS, f"""SELECT {_MICROS.format('min(ts)')} AS start, {_MICROS.format('max(ts) + INTERVAL 30 MINUTE')} AS "end",
  client_id, count(*) AS n, count(*) FILTER (predicted_action <> 'allow') AS n_flagged, max(latency_s) AS max_latency_s
FROM (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts, comment_id) AS session
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts, comment_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM d))
GROUP BY client_id, session {_closed}""")
for _name, _limit, _span in (("x05_sliding_rates_batch", fv.RATE_LIMIT_BATCH, 60), ("x05_sliding_rates_day", 4, 86_400)):
    ORACLES[_name] = f"""SELECT user_id AS client_id, event_id AS comment_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {_span * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > {_limit}"""
ORACLES["x05_rate_limit_single"] = f"""SELECT {_MICROS.format("date_trunc('minute', ts)")} AS start, user_id AS client_id, count(*) AS n
FROM events GROUP BY ALL HAVING count(*) > {fv.RATE_LIMIT_SINGLE}"""
ORACLES["x05_rate_limit_report"] = f"""SELECT {_STAMP.format("date_trunc('day', ts)")} AS start, user_id AS client_id, count(*) AS n
FROM events GROUP BY ALL HAVING count(*) > 4"""
for _name in ("x06_stream_feedback_join", "x06_attach_feedback"):
    ORACLES[_name] = decided(EVENTS, f"""SELECT f.comment_id AS feedback_id, CASE WHEN f.at - m.ts <= INTERVAL 7 DAY THEN m.comment_id END AS comment_id,
  {pick(fv.ACTIONS, 'f.client_id % 3')} AS human_action, CASE WHEN f.at - m.ts <= INTERVAL 7 DAY THEN m.predicted_action END AS predicted_action,
  CASE WHEN f.at - m.ts <= INTERVAL 7 DAY THEN epoch_us(f.at) - epoch_us(m.ts) END AS lag_us
FROM f ASOF LEFT JOIN m ON f.text = m.text AND f.at >= m.ts""", """,
m AS (SELECT text, ts, max(comment_id) AS comment_id, arg_max(predicted_action, comment_id) AS predicted_action FROM d GROUP BY text, ts),
f AS (SELECT *, ts + to_minutes(comment_id % 97) AS at FROM d)""")
ORACLES["u01_register_scorer"] = decided(
    f"SELECT * REPLACE (length(text)::DOUBLE / (length(text) + 100) AS given) FROM ({DOCS})",
    "SELECT comment_id, model_toxicity_score, predicted_action, risk_score FROM d",
)
