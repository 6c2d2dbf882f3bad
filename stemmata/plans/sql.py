"""DuckDB SQL for the registered queries: the same rules, written once more and independently of the Spark plans."""

from __future__ import annotations

from stemmata.functions import lexicon as lx
from stemmata.functions import tokenize as tk
from stemmata.functions.fingerprint import ANCHORS, SPAN, WIDE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


B = r"[ \t\n\f\r]"
PUNCT = r"[!-/:-@\[-`{-~]"
TEXTS = "texts AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


def tokens(source: str = "texts", key: str = "doc_id", name: str = "words") -> str:
    """Tokens of ``source(key, text)``: (key, num, s, e, w). Right for texts without ellipses, as all in the tables are."""
    return f"""{name}_0 AS (SELECT {key}, regexp_extract_all(text, {q(B + '*(?:' + tk.TOKEN + ')')}) AS toks FROM {source}),
{name}_1 AS (SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {name}_0),
{name}_2 AS (SELECT {key}, pos, regexp_replace(tok, '^{B}+', '') AS w, sum(length(tok)) OVER (PARTITION BY {key} ORDER BY pos) AS e FROM {name}_1),
{name} AS (SELECT {key}, CAST(pos - 1 AS INTEGER) AS num, CAST(e - length(w) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, w FROM {name}_2)"""


SENTENCES = rf"""sent_0 AS (SELECT doc_id, string_split(regexp_replace(text, {q('([.!?]+["' + "'" + r')\]]*' + B + '+)')}, '\1' || chr(1), 'g'), chr(1)) AS ps FROM texts),
sent_1 AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM sent_0),
sent_2 AS (SELECT doc_id, pos, p, regexp_replace(p, '^{B}+', '') AS lp, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM sent_1),
sent_3 AS (SELECT doc_id, pos, CAST(e - length(lp) AS INTEGER) AS s, regexp_replace(lp, '{B}+$', '') AS t FROM sent_2),
sentences AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS num, s, CAST(s + length(t) AS INTEGER) AS e, t FROM sent_3 WHERE t <> '')"""


def between(name: str, separator: str, keep: str) -> str:
    """Pieces between separators: the odd ones of an alternating list."""
    return rf"""{name}_0 AS (SELECT doc_id, string_split(regexp_replace(text, '({separator})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps FROM texts),
{name}_1 AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS pos, len(ps) AS n FROM {name}_0),
{name}_2 AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM {name}_1),
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS num, CAST(e - length(t) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, t FROM {name}_2 WHERE pos % 2 = 1 AND {keep})"""


#: the tables' texts have single line feeds: doubled, each line is a paragraph
SPACED = "texts AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
PARAGRAPHS = between("paragraphs", rf"{B}*\n\n+{B}*", "(t <> '' OR pos < n)")
LINES = between("lines", rf"{B}*\n{B}*", "t <> ''")


def nchars(n: int, name: str = "atoms") -> str:
    return f"""{name}_0 AS (SELECT doc_id, text, length(text) AS size, unnest(range(greatest(1, length(text) // {n}))) AS k FROM texts),
{name}_1 AS (SELECT *, k * {n} AS s, CASE WHEN k = greatest(1, size // {n}) - 1 THEN size ELSE (k + 1) * {n} END AS e FROM {name}_0),
{name} AS (SELECT doc_id, CAST(k AS INTEGER) AS atom_num, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, substr(text, s + 1, e - s) AS text FROM {name}_1)"""


def atoms_of(ctes: str, source: str, texts: str = TEXTS) -> str:
    return f'WITH {texts}, {ctes} SELECT doc_id, num AS atom_num, s AS start, e AS "end", {"w" if source == "words" else "t"} AS text FROM {source}'


def norm(w: str = "w") -> str:
    return f"lower(regexp_replace({w}, '{PUNCT}', '', 'g'))"


TAG = (
    f"CASE WHEN {norm()} = '' THEN '.' "
    + " ".join(f"WHEN {norm()} IN {among(members)} THEN {q(name)}" for name, members in lx.TAGS)
    + f" WHEN regexp_matches({norm()}, '(ed|ing)$') THEN 'VB' WHEN regexp_matches(w, '^[A-Z]') THEN 'NP' WHEN {norm()} LIKE '%s' THEN 'NNS' ELSE 'NN' END"
)
COMPLEXITY = f"2 * count(*) FILTER ({norm()} IN {among(lx.SUBORDINATING)}) + 2 * count(*) FILTER ({TAG} IN {among(lx.WH)}) + count(*) FILTER ({TAG} LIKE 'VB%')"
CLASSES = f"""counts AS (SELECT doc_id, {norm()} AS word, count(*) AS n FROM words GROUP BY ALL),
classes AS (SELECT doc_id, word, floor(log2(max(n) OVER (PARTITION BY doc_id) / n)) AS freq_class FROM counts)"""
#: words beside the atoms that they touch
ATOM_WORDS = "aw AS (SELECT a.doc_id, a.atom_num, w.num, w.s, w.e, w.w FROM atoms a JOIN words w ON a.doc_id = w.doc_id AND w.s < a.e AND w.e > a.s)"
UNIGRAM = "lower(regexp_replace(w, '^\\.+|\\.+$', '', 'g'))"
WORD_FEATURES = f"""WITH {TEXTS}, {tokens()}, {nchars(500)}, {CLASSES}, {ATOM_WORDS}
SELECT aw.doc_id, atom_num, CAST(sum(e - s) AS DOUBLE) AS num_chars, round(sum(e - s) / count(*), 6) AS average_word_length, round(sum((e - s) % 3) / count(*), 6) AS average_syllables_per_word,
  round(avg(CASE WHEN {norm()} IN {among(lx.STOP)} THEN 1.0 ELSE 0.0 END), 6) AS stopword_percentage, CAST({COMPLEXITY} AS DOUBLE) AS syntactic_complexity, round(avg(freq_class), 6) AS avg_internal_word_freq_class,
  {", ".join(f"CAST(count(*) FILTER ({UNIGRAM} = '{u}') AS DOUBLE) AS {chr(34)}word_unigram,{u}{chr(34)}" for u in lx.UNIGRAMS)}
FROM aw JOIN classes c ON c.doc_id = aw.doc_id AND c.word = {norm()} GROUP BY aw.doc_id, atom_num"""
WORD_FREQUENCIES = f"WITH {TEXTS}, {tokens()} SELECT {norm()} AS word, count(*) AS n FROM words GROUP BY 1"
EXTERNAL = f"""WITH {TEXTS}, {tokens()}, {nchars(500)}, f AS (SELECT {norm()} AS word, count(*) AS n FROM words GROUP BY 1), {ATOM_WORDS}
SELECT doc_id, atom_num, round(avg(floor(log2(((SELECT max(n) FROM f) + 1) / (n + 1)))), 6) AS avg_external_word_freq_class FROM aw JOIN f ON f.word = {norm()} GROUP BY ALL"""
TRIGRAMS = f"""WITH {TEXTS}, {tokens()}, {nchars(500)}, {ATOM_WORDS}, tagged AS (SELECT doc_id, atom_num, num, {TAG} AS a FROM aw),
triples AS (SELECT doc_id, atom_num, a || ',' || lead(a, 1) OVER w || ',' || lead(a, 2) OVER w AS t FROM tagged WINDOW w AS (PARTITION BY doc_id, atom_num ORDER BY num))
SELECT doc_id, atom_num, {", ".join(f"CAST(count(*) FILTER (t = '{t}') AS DOUBLE) AS {chr(34)}pos_trigram,{t}{chr(34)}" for t in lx.POS_TRIGRAMS)} FROM triples GROUP BY ALL"""
CHAR_FEATURES = f"""WITH {TEXTS}, {nchars(500)},
k AS (SELECT doc_id, atom_num, text, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z]', '.', 'g'), '[aeiou]', 'V', 'g'), '[a-z]', 'C', 'g') AS kinds FROM atoms),
t AS (SELECT doc_id, atom_num, unnest(list_transform(range(1, greatest(length(kinds) - 1, 1)), lambda i: substr(kinds, i, 3))) AS t FROM k),
c AS (SELECT doc_id, atom_num, {", ".join(f"count(*) FILTER (t = '{t.replace(',', '')}') AS t{i}" for i, t in enumerate(lx.VOWEL_TRIGRAMS))} FROM t GROUP BY ALL)
SELECT k.doc_id, k.atom_num, round((length(text) - length(translate(text, {q(lx.MARKS)}, ''))) / greatest(length(text), 1), 6) AS punctuation_percentage,
  {", ".join(f"CAST(coalesce(t{i}, 0) AS DOUBLE) AS {chr(34)}vowelness_trigram,{t}{chr(34)}" for i, t in enumerate(lx.VOWEL_TRIGRAMS))} FROM k LEFT JOIN c USING (doc_id, atom_num)"""
SENTENCE_WORDS = "sw AS (SELECT s.doc_id, s.num AS sent, w.s, w.e, w.w FROM sentences s JOIN words w ON s.doc_id = w.doc_id AND w.s < s.e AND w.e > s.s)"
ATOM_SENTENCES = "ats AS (SELECT a.doc_id, a.atom_num, s.num AS sent FROM atoms a JOIN sentences s ON a.doc_id = s.doc_id AND s.s < a.e AND s.e > a.s)"
SENTENCE_FEATURES = f"""WITH {TEXTS}, {tokens()}, {SENTENCES}, {nchars(500)}, {SENTENCE_WORDS}, {ATOM_SENTENCES},
per AS (SELECT doc_id, sent, count(*) AS words, count(*) FILTER ((e - s) % 3 > 2) AS complex, {COMPLEXITY} AS complexity FROM sw GROUP BY ALL),
sums AS (SELECT doc_id, atom_num, count(*) AS sentences, sum(words) AS words, sum(complex) AS complex, sum(complexity) AS complexity FROM ats JOIN per USING (doc_id, sent) GROUP BY ALL),
stems AS (SELECT doc_id, atom_num, {norm()} AS stem, count(*) AS f FROM ats JOIN sw USING (doc_id, sent) GROUP BY ALL),
v AS (SELECT doc_id, atom_num, count(*) AS v, count(*) FILTER (f = 1) AS v1, sum(f * f) AS m2 FROM stems GROUP BY ALL)
SELECT doc_id, atom_num, round(words / sentences, 6) AS average_sentence_length, round(0.4 * (words / sentences + 100 * complex / words), 6) AS gunning_fog_index,
  round(100 * ln(words) / (1 - v1 / (v + 1)), 6) AS honore_r_measure, round(10000.0 * (m2 - v) / (v * v), 6) AS yule_k_characteristic, round(complexity / sentences, 6) AS syntactic_complexity_average
FROM sums JOIN v USING (doc_id, atom_num)"""
#: no document has an empty paragraph with words, so paragraphs serve as atoms of their own
PARAGRAPH_FEATURES = f"""WITH {SPACED}, {tokens()}, {SENTENCES}, {PARAGRAPHS}, {CLASSES},
pw AS (SELECT p.doc_id, p.num AS par, w.num, w.s, w.e, w.w, {TAG} AS tag FROM paragraphs p JOIN words w ON p.doc_id = w.doc_id AND w.s < p.e AND w.e > p.s),
t AS (SELECT *, tag || ',' || lead(tag, 1) OVER o || ',' || lead(tag, 2) OVER o AS t FROM pw WINDOW o AS (PARTITION BY doc_id, par ORDER BY num)),
c AS (SELECT t.doc_id, par, count(*) AS n, sum((e - s) % 3) AS syl, sum(e - s) AS num_chars, avg(CASE WHEN {norm()} IN {among(lx.STOP)} THEN 1.0 ELSE 0.0 END) AS stop, {COMPLEXITY} AS l, avg(freq_class) AS d,
  count(*) FILTER (t = 'NN,NN,VB') AS p, count(*) FILTER (t = 'NN,NN,NN') AS x, count(*) FILTER (t = 'NN,IN,DT') AS y, count(*) FILTER (t = 'DT,NNS,IN') AS w4, count(*) FILTER (t = 'VB,NN,VB') AS x6, count(*) FILTER (t = 'DT,NN,IN') AS y6, count(*) FILTER ({UNIGRAM} = 'been') AS been
  FROM t JOIN classes k ON k.doc_id = t.doc_id AND k.word = {norm()} GROUP BY t.doc_id, par),
f AS (SELECT doc_id, par, {norm()} AS stem, count(*) AS f FROM pw GROUP BY ALL),
v AS (SELECT doc_id, par, count(*) AS v, count(*) FILTER (f = 1) AS v1 FROM f GROUP BY ALL),
n AS (SELECT p.doc_id, p.num AS par, count(*) AS sents FROM paragraphs p JOIN sentences s ON p.doc_id = s.doc_id AND s.s < p.e AND s.e > p.s GROUP BY ALL),
h AS (SELECT *, 100 * ln(n) / (1 - v1 / (v + 1)) AS h, 206.835 - 1.015 * n / sents - 84.6 * syl / n AS ease, 0.39 * n / sents + 11.8 * syl / n - 15.59 AS grade, syl / n AS b FROM c JOIN v USING (doc_id, par) JOIN n USING (doc_id, par)),
two AS (SELECT *, (1.5 * d - y + pow(12.0, 10) + l + 30.0) * (10.0 * (pow(1.5 + p, -12.0 - h) + 12.0 * x + 1.0)) AS two FROM h),
e AS (SELECT *, CASE WHEN isnan(u) OR isinf(u) THEN 1e255 ELSE u END AS five0 FROM (SELECT *, pow(1.5 - h, CASE WHEN h > 1.5 AND b <> floor(b) THEN floor(b) ELSE b END) - b - h - 3 AS u FROM two)),
z AS (SELECT doc_id, par AS atom_num, ease, grade, two, two - 2 * num_chars - stop + l AS three, two + grade + 6 * ease + stop - w4 AS four,
  CASE WHEN five0 * ln(4) + ln(5) > 700 THEN 1e255 ELSE 5 * pow(4.0, least(five0, 500)) END AS five,
  CASE WHEN x6 = 0 AND y6 = 0 OR x6 = 1 THEN 20 * been * ease * 6.5 + two WHEN pow(CAST(x6 AS DOUBLE), y6) * ln(6.5) > 700 THEN CASE WHEN been * ease = 0 THEN 1e255 ELSE 1e255 END ELSE 20 * been * ease * pow(6.5, pow(CAST(x6 AS DOUBLE), y6)) + two END AS six FROM e)
SELECT doc_id, atom_num, round(ease, 6) AS flesch_reading_ease, round(grade, 6) AS flesch_kincaid_grade,
  {", ".join(f"round(sign({k}) * log10(1 + abs({k})), 6) AS log_evolved_{k}" for k in ("two", "three", "four", "five", "six"))} FROM z"""
NESTED = f"""WITH {TEXTS}, {tokens()}, {SENTENCES}, {nchars(500)}, {SENTENCE_WORDS}, {ATOM_SENTENCES},
per AS (SELECT doc_id, sent, CAST(sum(e - s) AS DOUBLE) AS c, avg(CASE WHEN {norm()} IN {among(lx.STOP)} THEN 1.0 ELSE 0.0 END) AS stop FROM sw GROUP BY ALL),
one AS (SELECT doc_id, atom_num, round(sum(c) / count(*), 6) AS "avg(num_chars)", round(stddev_pop(c), 6) AS "std(num_chars)", round(stddev_pop(stop), 6) AS "std(stopword_percentage)" FROM ats JOIN per USING (doc_id, sent) GROUP BY ALL),
share AS (SELECT doc_id, atom_num, round(avg(CASE WHEN {norm()} IN {among(lx.STOP)} THEN 1.0 ELSE 0.0 END) / count(DISTINCT sent), 6) AS "avg(stopword_percentage)" FROM ats JOIN sw USING (doc_id, sent) GROUP BY ALL)
SELECT * FROM one JOIN share USING (doc_id, atom_num)"""

LONG = f"""long AS (SELECT doc_id, atom_num, unnest(['average_syllables_per_word', 'average_word_length', 'num_chars', 'stopword_percentage', 'syntactic_complexity']) AS feature, unnest([v2, v1, v0, v3, v4]) AS value FROM (
  SELECT doc_id, atom_num, CAST(sum(e - s) AS DOUBLE) AS v0, sum(e - s) / count(*) AS v1, sum((e - s) % 3) / count(*) AS v2, avg(CASE WHEN {norm()} IN {among(lx.STOP)} THEN 1.0 ELSE 0.0 END) AS v3, CAST({COMPLEXITY} AS DOUBLE) AS v4 FROM aw GROUP BY ALL))"""
BASE = f"{TEXTS}, {tokens()}, {nchars(500)}, {ATOM_WORDS}, {LONG}"


def outlier(long: str = "long", key: str = "doc_id", name: str = "scored") -> str:
    return f"""{name}_0 AS (SELECT *, count(*) OVER (PARTITION BY {key}, feature) AS n, row_number() OVER (PARTITION BY {key}, feature ORDER BY value, atom_num) AS r FROM {long}),
{name}_1 AS (SELECT *, avg(value) FILTER (r > 1 AND r < n) OVER w AS mean, stddev_pop(value) FILTER (r > 1 AND r < n) OVER w AS sd, min(value) OVER w AS low, max(value) OVER w AS high FROM {name}_0 WINDOW w AS (PARTITION BY {key}, feature)),
{name}_2 AS (SELECT *, abs(value - mean) AS off, exp(-0.5 * pow((value - mean) / nullif(sd, 0), 2)) / (nullif(sd, 0) * sqrt(2 * pi())) AS g, CASE WHEN high = low THEN 1.0 ELSE 1 / (high - low) END AS u FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN sd > 1e-12 AND NOT (off BETWEEN sd * (1 - 1e-9) AND sd * (2 + 1e-9)) THEN ln(u / (u + CASE WHEN g > 0 THEN g ELSE 1e-30 END)) END AS c FROM {name}_2),
{name} AS (SELECT {key}, atom_num, coalesce(exp(sum(c)), 0.2) AS confidence FROM {name}_3 GROUP BY {key}, atom_num)"""


OUTLIER = f"WITH {BASE}, {outlier()} SELECT doc_id, atom_num, round(confidence, 6) AS confidence FROM scored"
MEDIAN = f"""WITH {BASE}, d AS (SELECT *, abs(value - median(value) OVER (PARTITION BY doc_id, feature)) AS d FROM long)
SELECT doc_id, atom_num, feature, round(CASE WHEN max(d) OVER (PARTITION BY doc_id, feature) > 0 THEN d / max(d) OVER (PARTITION BY doc_id, feature) ELSE 0 END, 6) AS confidence FROM d"""
RESCALED = f"""WITH {BASE}, {outlier()}, m AS (SELECT *, least(min(confidence) OVER (PARTITION BY doc_id), 0) AS lift, max(confidence) OVER (PARTITION BY doc_id) AS top FROM scored)
SELECT doc_id, atom_num, round(CASE WHEN top - lift = 0 THEN 0.2 ELSE (confidence - lift) / (top - lift) END, 6) AS confidence FROM m"""
DISTRIBUTION = f"""WITH {BASE} SELECT feature, count(*) AS n, round(min(value), 6) AS "min", round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS "median", round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS "max", round(avg(value), 6) AS mean FROM long GROUP BY feature"""
FEATURES5 = ["average_syllables_per_word", "average_word_length", "num_chars", "stopword_percentage", "syntactic_complexity"]
UNMASK = f"""WITH {BASE}, sets AS (SELECT unnest({['control', *FEATURES5]}) AS removed),
each AS (SELECT doc_id || ' ' || removed AS pair, doc_id, removed, atom_num, feature, value FROM long CROSS JOIN sets WHERE removed <> feature), {outlier("each", "pair")}
SELECT split_part(pair, ' ', 2) AS removed, CAST(split_part(pair, ' ', 1) AS BIGINT) AS doc_id, round(avg(CASE WHEN confidence > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM scored GROUP BY pair"""


def winnowed(source: str, key: str, name: str, k: int = 8, t: int = 13, span: int = SPAN) -> str:
    """(key, h): the distinct winnowed hashes of ``source(key, text)``."""
    w = t - k + 1
    steps = f"SELECT {key}, pos, u AS h0, {', '.join(f'lead(u, {j}) OVER o AS u{j}' for j in range(1, k))} FROM {name}_u WINDOW o AS (PARTITION BY {key} ORDER BY pos)"
    for j in range(1, k):
        steps = f"SELECT {key}, pos, {', '.join(f'u{i}' for i in range(j + 1, k)) + ', ' if j + 1 < k else ''}xor(h{j - 1}, u{j} + (h{j - 1} << 6) + (h{j - 1} >> 2)) AS h{j} FROM ({steps})"
    return rf"""{name}_p AS (SELECT {key}, regexp_replace(lower(regexp_replace(text, '{PUNCT}', '', 'g')), '[ \t\n\f\r\v]+', '', 'g') AS t FROM {source}),
{name}_c AS (SELECT {key}, string_split(t, '') AS cs FROM {name}_p WHERE length(t) >= {k}),
{name}_u AS MATERIALIZED (SELECT {key}, CAST(unicode(c) AS BIGINT) AS u, pos FROM (SELECT {key}, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM {name}_c)),
{name}_h AS MATERIALIZED (SELECT {key}, pos, h{k - 1} % {span} AS h FROM ({steps}) WHERE h{k - 1} IS NOT NULL),
{name}_m AS (SELECT {key}, pos, h, min(h) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m, lead(h, {w - 1}) OVER (PARTITION BY {key} ORDER BY pos) AS last FROM {name}_h),
{name}_e AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY {key} ORDER BY pos), h) AS before FROM {name}_m WHERE last IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, m AS h FROM {name}_e WHERE m <> before OR m = last)"""


def wide(source: str, key: str, name: str) -> str:
    return winnowed(source, key, name, span=WIDE)


ITEMS = "items AS (SELECT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)"
WINNOW = f"WITH {TEXTS}, {winnowed('texts', 'doc_id', 'd')} SELECT doc_id, 0 AS atom_num, h AS hash_value FROM d"
DIGRAMS = f"""{TEXTS}, dg AS (SELECT substr(t, i, 2) AS digram, count(*) AS n FROM (SELECT lower(text) AS t, unnest(range(1, greatest(length(text), 1))) AS i FROM texts) WHERE regexp_matches(substr(t, i, 2), '^[a-z][a-z]$') GROUP BY 1)"""
ANCHOR_SQL = f"""WITH {DIGRAMS}, r AS (SELECT digram, n, row_number() OVER (ORDER BY n DESC, digram) AS rank, count(*) OVER () AS a FROM dg) SELECT CAST(rank AS INTEGER) AS rank, digram, n FROM r WHERE rank > floor(a * 0.15) AND rank <= floor(a * 0.15) + 10"""


def stripped(source: str, key: str, name: str) -> str:
    """Words without punctuation, renumbered: (key, i, w, size)."""
    order = f"PARTITION BY {key} ORDER BY num"
    return f"{name} AS (SELECT {key}, row_number() OVER ({order}) - 1 AS i, regexp_replace(w, '{PUNCT}', '', 'g') AS w, count(*) OVER (PARTITION BY {key}) AS size FROM {source} WHERE instr({q(tk.PUNCTUATION)}, w) = 0)"


FULL = f"""WITH {TEXTS}, {tokens()}, {stripped("words", "doc_id", "v")},
g AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS gram FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g WHERE gram IS NOT NULL GROUP BY gram"""
KTH = f"""WITH {TEXTS}, {SENTENCES}, st AS (SELECT doc_id, num AS sent, t AS text FROM sentences), {tokens("st", "doc_id, sent", "sws")}, {stripped("sws", "doc_id, sent", "v")},
g AS (SELECT doc_id, sent, string_agg(w, ' ' ORDER BY i) AS gram FROM v WHERE i >= least(3, size - least(5, size)) AND i < least(8, size) GROUP BY ALL)
SELECT st.doc_id, coalesce(gram, '') AS gram, count(*) AS n FROM st LEFT JOIN g USING (doc_id, sent) GROUP BY ALL"""
ANCHORED = f"""WITH {TEXTS}, {tokens()}, {stripped("words", "doc_id", "v")},
a AS (SELECT doc_id, i, size, greatest(0, i - 2) AS lo, least(i + 2, size) + 1 AS hi FROM v WHERE regexp_matches(w, '{"|".join(ANCHORS)}')),
g AS (SELECT a.doc_id, a.i, string_agg(v.w, ' ' ORDER BY v.i) AS gram FROM a JOIN v ON a.doc_id = v.doc_id AND v.i >= lo AND v.i < hi WHERE hi - lo = 5 GROUP BY ALL)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL"""


def pairs(measure: str, a: str, b: str, a_key: str, b_key: str, other: bool = False) -> str:
    """Scored pairs of two hash tables whose columns are (a_key, h) and (b_key, h); a hash of 0 only counts in sizes."""
    ak, bk = a_key.split(", "), b_key.split(", ")
    shared = "n0 + za * zb"
    value = f"({shared}) / sa" if measure.startswith("containment") else f"({shared}) / (sa + sb - ({shared}))"
    if measure.endswith("alt1"):
        value = f"CASE WHEN {shared} < 2 THEN 0 ELSE {value} END"
    where = "WHERE a.doc_id <> b.source_id" if other else ""
    return f"""p_n AS (SELECT {', '.join(f'a.{x}' for x in ak)}, {', '.join(f'b.{x}' for x in bk)}, count(*) AS n0 FROM {a} a JOIN {b} b ON a.h = b.h AND a.h <> 0 {where} GROUP BY ALL),
p_a AS (SELECT {a_key}, count(*) AS sa, max(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS za FROM {a} GROUP BY ALL), p_b AS (SELECT {b_key}, count(*) AS sb, max(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS zb FROM {b} GROUP BY ALL),
scored_pairs AS (SELECT {a_key}, {b_key}, {shared} AS shared, {value} AS confidence FROM p_n JOIN p_a USING ({a_key}) JOIN p_b USING ({b_key}))"""


def itemed(measure: str) -> str:
    """Benchmark items as suspects, whole documents as sources: the likeliest source of each item."""
    return f"""WITH {TEXTS}, {ITEMS}, {wide('texts', 'doc_id', 'd')}, {wide('items', 'item_id', 'i')}, src AS (SELECT doc_id AS source_id, h FROM d), sus AS (SELECT item_id AS doc_id, h FROM i),
{pairs(measure, 'sus', 'src', 'doc_id', 'source_id')}, top AS (SELECT * FROM scored_pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, source_id) = 1)
SELECT s.doc_id AS item_id, source_id, coalesce(shared, 0) AS shared, round(coalesce(confidence, 0), 6) AS confidence FROM (SELECT DISTINCT doc_id FROM sus) s LEFT JOIN top USING (doc_id)"""


_ATOM_HASHES = f"{nchars(500)}, {wide('atoms', 'doc_id, atom_num', 'ah')}, {ITEMS}, {wide('items', 'item_id', 'ih')}, src AS (SELECT item_id AS source_id, h FROM ih)"
EXT = f"""{_ATOM_HASHES}, {pairs('jaccard', 'ah', 'src', 'doc_id, atom_num', 'source_id')},
ext AS (SELECT a.doc_id, a.atom_num, source_id, coalesce(shared, 0) AS shared, coalesce(confidence, 0) AS confidence FROM atoms a LEFT JOIN
  (SELECT * FROM scored_pairs QUALIFY row_number() OVER (PARTITION BY doc_id, atom_num ORDER BY confidence DESC, source_id) = 1) USING (doc_id, atom_num))"""
ATOM_SEARCH = f"WITH {TEXTS}, {EXT} SELECT doc_id, atom_num, source_id, shared, round(confidence, 6) AS confidence FROM ext"
TWO_LEVEL = f"""WITH {TEXTS}, {_ATOM_HASHES}, {wide('texts', 'doc_id', 'dh')}, sus AS (SELECT doc_id, h FROM dh), {pairs('containment', 'sus', 'src', 'doc_id', 'source_id').replace('p_', 'q_').replace('scored_pairs', 'level1')},
chosen AS (SELECT doc_id, source_id FROM level1 WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, source_id) <= 5), {pairs('containment', 'ah', 'src', 'doc_id, atom_num', 'source_id')},
top AS (SELECT * FROM scored_pairs SEMI JOIN chosen USING (doc_id, source_id) QUALIFY row_number() OVER (PARTITION BY doc_id, atom_num ORDER BY confidence DESC, source_id) = 1)
SELECT s.doc_id, s.atom_num, source_id, coalesce(shared, 0) AS shared, round(coalesce(confidence, 0), 6) AS confidence FROM (SELECT DISTINCT doc_id, atom_num FROM ah) s LEFT JOIN top USING (doc_id, atom_num)"""
#: every place of each item, overlapping ones too
SPANS = f"""{ITEMS}, held AS MATERIALIZED (SELECT t.doc_id, i.item_id AS source_id, t.text, i.text AS p FROM texts t JOIN items i ON instr(t.text, i.text) > 0 AND i.text <> ''),
occ_0 AS (SELECT doc_id, source_id, length(p) AS n, unnest(list_filter(range(1, length(text) - length(p) + 2), lambda k: substr(text, k, length(p)) = p)) AS k FROM held),
occ AS (SELECT doc_id, source_id, CAST(k - 1 AS INTEGER) AS s, CAST(k - 1 + n AS INTEGER) AS e FROM occ_0)"""
OCCURRENCES = f'WITH {TEXTS}, {SPANS} SELECT doc_id, source_id, s AS start, e AS "end" FROM occ'
_EXT_ONLY = EXT.replace(f"{ITEMS}, ", "", 1)
TRUTH_CTE = f"""{SPANS}, truth AS (SELECT a.doc_id, a.atom_num, a.s, a.e, max(CASE WHEN o.s < a.e AND o.e > a.s THEN 1 ELSE 0 END) AS truth,
  coalesce(sum(CASE WHEN o.s < a.e AND o.e > a.s THEN least(a.e, o.e) - greatest(a.s, o.s) END), 0) AS n_plag FROM atoms a LEFT JOIN occ o USING (doc_id) GROUP BY ALL)"""
TRUTH = f'WITH {TEXTS}, {nchars(500)}, {TRUTH_CTE} SELECT doc_id, atom_num, s AS start, e AS "end", CAST(truth AS INTEGER) AS truth, CAST(n_plag AS BIGINT) AS n_plag FROM truth'
_JUDGED = f"{TEXTS}, {EXT}, {TRUTH_CTE.replace(f'{ITEMS}, ', '', 1)}"


def auc(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}count(*) AS n, sum(actual) AS positives, round((sum(r) FILTER (actual = 1) - sum(actual) * (sum(actual) + 1) / 2) / nullif(sum(actual) * (count(*) - sum(actual)), 0), 6) AS auc
FROM (SELECT *, rank() OVER ({part}ORDER BY confidence) + (count(*) OVER (PARTITION BY {g}confidence) - 1) / 2 AS r FROM {source}) {"GROUP BY " + group if group else ""}"""


AUC = f"WITH {_JUDGED}, j AS (SELECT truth AS actual, round(confidence, 9) AS confidence FROM truth JOIN ext USING (doc_id, atom_num)) {auc('j')}"
ROC = f"""WITH {_JUDGED}, j AS (SELECT truth AS actual, round(confidence, 6) AS confidence FROM truth JOIN ext USING (doc_id, atom_num)), g AS (SELECT confidence, sum(actual) AS p, sum(1 - actual) AS n FROM j GROUP BY 1)
SELECT confidence AS threshold, round(sum(n) OVER (ORDER BY confidence DESC) / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY confidence DESC) / sum(p) OVER (), 6) AS tpr FROM g"""
SWEEP = f"""WITH {_JUDGED}, th AS (SELECT unnest(range(20)) / 20 AS threshold), ds AS (SELECT DISTINCT doc_id FROM truth),
det AS (SELECT t.doc_id, threshold, t.s, t.e FROM truth t JOIN ext USING (doc_id, atom_num) CROSS JOIN th WHERE confidence > threshold),
sp AS (SELECT doc_id, threshold, source_id, s, e FROM occ CROSS JOIN th),
rec AS (SELECT sp.doc_id, sp.threshold, sp.source_id, sp.s, sp.e, coalesce(sum(CASE WHEN det.s < sp.e AND det.e > sp.s THEN least(sp.e, det.e) - greatest(sp.s, det.s) END), 0) / any_value(sp.e - sp.s) AS r, count(*) FILTER (det.s < sp.e AND det.e > sp.s) AS c FROM sp LEFT JOIN det USING (doc_id, threshold) GROUP BY ALL),
prec AS (SELECT det.doc_id, det.threshold, det.s, coalesce(sum(CASE WHEN det.s < sp.e AND det.e > sp.s THEN least(sp.e, det.e) - greatest(sp.s, det.s) END), 0) / any_value(det.e - det.s) AS p FROM det LEFT JOIN sp USING (doc_id, threshold) GROUP BY ALL),
r2 AS (SELECT doc_id, threshold, avg(coalesce(r, 0)) AS recall, sum(c * c) / nullif(sum(c), 0) AS gran FROM rec GROUP BY ALL), p2 AS (SELECT doc_id, threshold, avg(p) AS precision FROM prec GROUP BY ALL),
m AS (SELECT doc_id, threshold, precision, recall, coalesce(gran, 1) AS granularity, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f FROM ds CROSS JOIN th LEFT JOIN r2 USING (doc_id, threshold) LEFT JOIN p2 USING (doc_id, threshold))
SELECT threshold, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f), 6) AS f_measure, round(avg(granularity), 6) AS granularity, round(avg(f / log2(1 + granularity)), 6) AS overall FROM m GROUP BY threshold"""
CONFUSION = f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (confidence > 0.2 AND truth = 1) AS tp, count(*) FILTER (confidence > 0.2 AND truth = 0) AS fp, count(*) FILTER (confidence <= 0.2 AND truth = 0) AS tn, count(*) FILTER (confidence <= 0.2 AND truth = 1) AS fn FROM truth JOIN ext USING (doc_id, atom_num))
SELECT tp AS true_pos, fp AS false_pos, tn AS true_neg, fn AS false_neg, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
WRONG = f"""WITH {_JUDGED} SELECT doc_id, atom_num, CAST(truth AS INTEGER) AS actual, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.2 THEN 'false_pos' ELSE 'false_neg' END AS kind, round(abs(truth - confidence), 6) AS how_wrong
FROM truth JOIN ext USING (doc_id, atom_num) WHERE (confidence > 0.2) <> (truth = 1)"""
SOURCE_ACCURACY = f"""WITH {_JUDGED}, j AS (SELECT t.doc_id, t.atom_num, x.source_id, EXISTS (SELECT 1 FROM occ o WHERE o.doc_id = t.doc_id AND o.source_id = x.source_id AND o.s < t.e AND o.e > t.s) AS ok FROM truth t JOIN ext x USING (doc_id, atom_num) WHERE truth = 1)
SELECT count(*) AS plagiarised, count(source_id) AS named, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / nullif(count(source_id), 0), 6) AS source_accuracy, round(count(*) FILTER (ok) / nullif(count(*), 0), 6) AS true_source_accuracy FROM j"""
TRANSITIONS = f"""WITH {TEXTS}, {nchars(500)}, {TRUTH_CTE}, m AS (SELECT lag(truth) OVER (PARTITION BY doc_id ORDER BY atom_num) AS previous, truth AS next FROM truth), c AS (SELECT previous, next, count(*) AS n FROM m WHERE previous IS NOT NULL GROUP BY ALL)
SELECT CAST(previous AS INTEGER) AS previous, CAST(next AS INTEGER) AS next, n, round(n / sum(n) OVER (PARTITION BY previous), 6) AS share FROM c"""
COMBINED_CTE = f"""{BASE}, {outlier()}, {_EXT_ONLY.replace(nchars(500) + ', ', '', 1).replace(wide('items', 'item_id', 'ih'), ITEMS + ', ' + wide('items', 'item_id', 'ih'), 1)}, {TRUTH_CTE.replace(f'{ITEMS}, ', '', 1)},
both_sides AS (SELECT s.doc_id, s.atom_num, s.confidence AS i, x.confidence AS x FROM scored s JOIN ext x USING (doc_id, atom_num))"""
COMBINED = f"""WITH {COMBINED_CTE} SELECT doc_id, atom_num, round(i, 6) AS intrinsic, round(x, 6) AS extrinsic, round((i + x) / 2, 6) AS arithmetic, round(sqrt((i + 0.001) * (x + 0.001)), 6) AS geometric,
  round(pow((pow(i + 0.001, 2) + pow(x + 0.001, 2)) / 2, 0.5), 6) AS power2, round(greatest(i, x), 6) AS largest, round(least(i, x), 6) AS smallest, round(i + x, 6) AS total FROM both_sides"""
THREE = f"""WITH {COMBINED_CTE}, j AS (SELECT truth AS actual, unnest(['intrinsic', 'extrinsic', 'combined']) AS evidence, unnest([round(i, 9), round(x, 9), round((i + x) / 2, 9)]) AS confidence FROM both_sides JOIN truth USING (doc_id, atom_num)) {auc('j', 'evidence')}"""
def _five(c: str, x: str = "", whole: bool = False) -> str:
    kind = "INTEGER" if not whole else "BIGINT"
    return f"""CAST(min({c}) AS {kind}) AS "{x}min", quantile_cont({c}, 0.25) AS {x}q1, quantile_cont({c}, 0.5) AS "{x}median", quantile_cont({c}, 0.75) AS {x}q3, CAST(max({c}) AS {kind}) AS "{x}max", round(avg({c}), 6) AS {x}mean"""


STATISTICS = f"""WITH {TEXTS}, {SPANS}, {PARAGRAPHS}, n AS (SELECT doc_id, count(*) AS n FROM paragraphs GROUP BY 1), p AS (SELECT doc_id, sum(e - s) AS plag FROM occ GROUP BY 1),
j AS (SELECT length(text) AS size, plag, coalesce(n, 0) AS n FROM texts LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT count(*) AS documents, round(avg(CASE WHEN plag IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share_with_plag, round(avg(CASE WHEN size >= 35000 THEN 1.0 ELSE 0.0 END), 6) AS share_long, {_five("size")}, {_five("plag", "plag_", True)},
  round(coalesce(sum(plag), 0) / sum(size), 6) AS plag_share, CAST(sum(n) AS BIGINT) AS paragraphs, round(avg(n), 6) AS paragraphs_mean FROM j"""
T_TEST = f"""WITH {BASE}, s AS (SELECT feature, doc_id, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY ALL)
SELECT a.feature, a.doc_id AS doc_a, b.doc_id AS doc_b, CASE WHEN abs((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0)) < 5e-7 THEN 0.0 ELSE round((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 6) END AS t,
  round(pow(a.v / a.n + b.v / b.n, 2) / nullif(pow(a.v / a.n, 2) / nullif(a.n - 1, 0) + pow(b.v / b.n, 2) / nullif(b.n - 1, 0), 0), 6) AS freedom
FROM s a JOIN s b ON a.feature = b.feature AND a.doc_id < b.doc_id"""


def draw(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 8) AS BIGINT) / 4294967296"


SPLIT = f"WITH {TEXTS} SELECT doc_id, CASE WHEN {draw(1)} < 0.7 THEN 'training' ELSE 'test' END AS part FROM texts"
EXACT_SPLIT = f"WITH {TEXTS} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {draw(1)}, doc_id) <= floor(count(*) OVER () * 0.7) THEN 'training' ELSE 'test' END AS part FROM texts"
WITH_SOURCES = f"""WITH {TEXTS}, {SPANS}, p AS (SELECT doc_id, CASE WHEN {draw(1)} < 0.7 THEN 'training' ELSE 'test' END AS part FROM texts)
SELECT part, 'suspect' AS role, doc_id AS id FROM p UNION ALL SELECT max(part), 'source', source_id FROM occ JOIN p USING (doc_id) GROUP BY source_id"""
CRISP = f"""WITH {TEXTS}, {SPANS}, {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), ok AS (SELECT DISTINCT doc_id, source_id, length(i.text) - length(replace(i.text, chr(10), '')) + 1 AS k FROM occ JOIN items i ON i.item_id = source_id)
SELECT doc_id FROM ok JOIN n USING (doc_id) GROUP BY doc_id HAVING max(k) <= 20 AND max(n) <= 20"""
VARIABLE = f"""WITH {TEXTS}, {SPANS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM texts), f AS (SELECT source_id, min(rank) AS rank FROM occ JOIN r USING (doc_id) GROUP BY 1), c AS (SELECT rank, count(*) AS new FROM f GROUP BY 1)
SELECT CAST(rank AS INTEGER) AS rank, doc_id, CAST(sum(coalesce(new, 0)) OVER (ORDER BY rank) AS BIGINT) AS source_cutoff FROM r LEFT JOIN c USING (rank)"""
TEST_CORPUS = f"""WITH {TEXTS}, {SPANS}, tr AS (SELECT doc_id FROM texts WHERE {draw(1)} < 0.7), used AS (SELECT source_id FROM occ SEMI JOIN tr USING (doc_id))
SELECT doc_id FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM tr) AND doc_id NOT IN (SELECT doc_id FROM occ WHERE source_id IN (SELECT source_id FROM used))"""
PREFIX = f"""WITH {TEXTS}, {SPANS}, c AS (SELECT doc_id FROM texts ORDER BY doc_id LIMIT 250) SELECT 'suspect' AS role, doc_id AS id FROM c UNION ALL SELECT DISTINCT 'source', source_id FROM occ SEMI JOIN c USING (doc_id)"""
SAMPLE = f"""WITH {TEXTS}, {SPANS}, c AS (SELECT doc_id FROM texts ORDER BY {draw(1)}, doc_id LIMIT 50) SELECT 'suspect' AS role, doc_id AS id FROM c UNION ALL SELECT DISTINCT 'source', source_id FROM occ SEMI JOIN c USING (doc_id)"""
TRAINING_FILES = f"""WITH {TEXTS}, {SPANS}, d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM occ) AS has_plag FROM texts WHERE length(text) >= 200)
SELECT doc_id, has_plag FROM d QUALIFY row_number() OVER (PARTITION BY has_plag ORDER BY doc_id) <= CASE WHEN has_plag THEN 20 ELSE 80 END"""
TAG_TRIGRAMS = f"""WITH {TEXTS}, {tokens()}, {SENTENCES}, sw AS (SELECT s.doc_id, s.num AS sent, w.num, w.w FROM sentences s JOIN words w ON s.doc_id = w.doc_id AND w.s < s.e AND w.e > s.s),
g AS (SELECT doc_id, sent, num, {TAG} AS a FROM sw), t AS (SELECT doc_id, a || ',' || lead(a, 1) OVER o || ',' || lead(a, 2) OVER o AS trigram FROM g WINDOW o AS (PARTITION BY doc_id, sent ORDER BY num))
SELECT trigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE trigram IS NOT NULL GROUP BY 1"""
TAG_TRIGRAM_DOCS = TAG_TRIGRAMS.replace("SELECT trigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE trigram IS NOT NULL GROUP BY 1", "SELECT trigram, doc_id, count(*) AS n FROM t WHERE trigram IS NOT NULL GROUP BY ALL")
LABEL_AUC = f"""WITH {BASE}, {outlier()}, d AS (SELECT doc_id, max(confidence) AS confidence FROM scored GROUP BY 1), j AS (SELECT 1 - quality AS actual, round(confidence, 9) AS confidence FROM d JOIN labels USING (doc_id)) {auc('j')}"""

TWO_LEVEL_PASSAGES = f"""WITH {TEXTS}, {_ATOM_HASHES}, {pairs('containment', 'ah', 'src', 'doc_id, atom_num', 'source_id')},
chosen AS (SELECT * FROM scored_pairs WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, atom_num ORDER BY confidence DESC, source_id) <= 5),
top AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY doc_id, atom_num ORDER BY confidence DESC, source_id) = 1)
SELECT s.doc_id, s.atom_num, CAST(1 AS INTEGER) AS rank, source_id, CASE WHEN source_id IS NOT NULL THEN CAST(0 AS INTEGER) END AS source_atom, coalesce(shared, 0) AS shared, round(coalesce(confidence, 0), 6) AS confidence
FROM (SELECT DISTINCT doc_id, atom_num FROM ah) s LEFT JOIN top USING (doc_id, atom_num)"""
SHORT_SEARCH = f"""WITH {TEXTS}, {EXT} SELECT doc_id, atom_num, CASE WHEN e - s >= 300 THEN source_id END AS source_id, CASE WHEN e - s >= 300 THEN shared ELSE 0 END AS shared, CASE WHEN e - s >= 300 THEN round(confidence, 6) ELSE 0.0 END AS confidence FROM ext JOIN atoms USING (doc_id, atom_num)"""
LOOKUP_DOCS = f"WITH {TEXTS}, {ITEMS}, {winnowed('texts', 'doc_id', 'd')}, {winnowed('items', 'item_id', 'i')} SELECT h AS hash_value, doc_id, 0 AS atom_num FROM d WHERE h IN (SELECT h FROM i) AND doc_id IN (SELECT doc_id FROM labels)"
INDEX = f"WITH {TEXTS}, {winnowed('texts', 'doc_id', 'd')} SELECT doc_id, 0 AS atom_num, h AS hash_value, CAST(h % 64 AS INTEGER) AS bucket FROM d"
OBFUSCATION = "CASE (doc_id + source_id) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'high' END"
GROUND_SOURCES = f"""WITH {TEXTS}, {nchars(500)}, {SPANS}, o AS (SELECT *, e - s AS n, {OBFUSCATION} AS obf FROM occ),
t AS (SELECT a.doc_id, a.atom_num, o.s, o.e, o.source_id, o.n, o.obf FROM atoms a LEFT JOIN o ON o.doc_id = a.doc_id AND o.s < a.e AND o.e > a.s)
SELECT doc_id, atom_num, CASE WHEN count(s) > 0 THEN 1 ELSE 0 END AS truth, coalesce(string_agg(s || '-' || e || ':' || source_id || ':0-' || n || ':' || obf, ' ' ORDER BY s, e, source_id), '') AS found FROM t GROUP BY doc_id, atom_num HAVING count(*) FILTER (obf = 'high') = 0"""
CHEATING = f"""WITH {TEXTS}, {nchars(500)}, {SPANS}, t AS (SELECT a.doc_id, a.atom_num, a.s, a.e, coalesce(max(CASE WHEN o.s < a.e AND o.e > a.s THEN least(a.e, o.e) - greatest(a.s, o.s) END), 0) AS most, coalesce(sum(CASE WHEN o.s < a.e AND o.e > a.s THEN least(a.e, o.e) - greatest(a.s, o.s) END), 0) AS n FROM atoms a LEFT JOIN occ o USING (doc_id) GROUP BY ALL)
SELECT doc_id, atom_num, s AS start, e AS "end", CASE WHEN most > (e - s) / 2 THEN 1 ELSE 0 END AS truth, CAST(n AS BIGINT) AS n_plag FROM t WHERE e - s >= 100 AND NOT (n > 0 AND n < (e - s) / 2)"""
ATTACHED = f"""WITH {TEXTS}, {nchars(500)}, {SPANS}, o AS (SELECT a.doc_id, a.atom_num, greatest(o.s, a.s) - a.s AS x, least(o.e, a.e) - a.s AS y, source_id FROM atoms a JOIN occ o ON a.doc_id = o.doc_id AND o.s < a.e AND o.e > a.s),
g AS (SELECT doc_id, atom_num, string_agg(x || '-' || y || ':' || source_id, ' ' ORDER BY x, y, source_id) AS f FROM o GROUP BY ALL),
first AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, atom_num ORDER BY x, y, source_id) = 1)
SELECT doc_id, atom_num, coalesce(f, '') AS plag_spans, CASE WHEN x IS NULL THEN text ELSE substr(text, 1, x) || '_' || substr(text, x + 1, y - x) || '_' || substr(text, y + 1) END AS marked FROM atoms LEFT JOIN g USING (doc_id, atom_num) LEFT JOIN first USING (doc_id, atom_num)"""
_BASES = {"num_chars": ("c", ""), "average_syllables_per_word": ("y", "n"), "stopword_percentage": ("p", "n"), "syntactic_complexity": ("l", ""), "avg_internal_word_freq_class": ("fi", "n"), "avg_external_word_freq_class": ("fx", "n")}
_PER = f"""sum(e - s) AS c, sum((e - s) % 3) AS y, count(*) FILTER ({norm()} IN {among(lx.STOP)}) AS p, {COMPLEXITY} AS l, sum(freq_class) AS fi, sum(floor(log2(((SELECT max(n) FROM f) + 1) / (f.n + 1)))) AS fx, count(*) AS n"""
_PER_FROM = f"JOIN classes k ON k.doc_id = q.doc_id AND k.word = {norm()} JOIN f ON f.word = {norm()}"
_F = f"f AS (SELECT {norm()} AS word, count(*) AS n FROM words GROUP BY 1)"
_ratio = lambda b, by: f"sum({_BASES[b][0]})" + (f" / sum({by}{_BASES[b][1]})" if _BASES[b][1] else "")
_value = lambda b: _BASES[b][0] + (f" / {_BASES[b][1]}" if _BASES[b][1] else "")
NESTED_SENTENCES = f"""WITH {TEXTS}, {tokens()}, {SENTENCES}, {nchars(500)}, {CLASSES}, {_F}, {SENTENCE_WORDS}, {ATOM_SENTENCES},
per AS (SELECT q.doc_id, sent, {_PER} FROM sw q {_PER_FROM} GROUP BY ALL)
SELECT doc_id, atom_num, {", ".join(f'round({_ratio(b, "")} / count(*), 6) AS "avg({b})", round(stddev_pop({_value(b)}), 6) AS "std({b})"' for b in _BASES)} FROM ats JOIN per USING (doc_id, sent) GROUP BY doc_id, atom_num"""
NESTED_PARAGRAPHS = f"""WITH {SPACED}, {tokens()}, {SENTENCES}, {PARAGRAPHS}, {nchars(500)}, {CLASSES}, {_F}, {SENTENCE_WORDS},
per AS (SELECT q.doc_id, sent, {_PER} FROM sw q {_PER_FROM} GROUP BY ALL),
pw AS (SELECT p.doc_id, p.num AS par, w.s, w.e, w.w FROM paragraphs p JOIN words w ON p.doc_id = w.doc_id AND w.s < p.e AND w.e > p.s),
pp AS (SELECT q.doc_id, par, {_PER} FROM pw q {_PER_FROM} GROUP BY ALL),
ps AS (SELECT p.doc_id, p.num AS par, s.num AS sent FROM paragraphs p JOIN sentences s ON p.doc_id = s.doc_id AND s.s < p.e AND s.e > p.s), k AS (SELECT doc_id, par, count(*) AS k FROM ps GROUP BY ALL),
ap AS (SELECT a.doc_id, a.atom_num, p.num AS par FROM atoms a JOIN paragraphs p ON a.doc_id = p.doc_id AND p.s < a.e AND p.e > a.s),
a1 AS (SELECT doc_id, atom_num, count(*) AS pars, sum(k) AS sents, {", ".join(f"{_ratio(b, '')} AS r{i}" for i, b in enumerate(_BASES))},
  round(sum(n) / sum(k) / count(*), 9) AS "avg(average_sentence_length)", round(stddev_pop(n / k), 9) AS "std(average_sentence_length)", round(sum(l) / sum(k) / count(*), 9) AS "avg(syntactic_complexity_average)", round(stddev_pop(l / k), 9) AS "std(syntactic_complexity_average)"
  FROM ap JOIN pp USING (doc_id, par) JOIN k USING (doc_id, par) GROUP BY doc_id, atom_num),
a2 AS (SELECT ap.doc_id, ap.atom_num, {", ".join(f"stddev_pop({_value(b)}) AS d{i}" for i, b in enumerate(_BASES))} FROM ap JOIN ps USING (doc_id, par) JOIN per USING (doc_id, sent) GROUP BY ap.doc_id, ap.atom_num)
SELECT doc_id, atom_num, {", ".join(f'round(r{i} / sents / pars, 9) AS "avg(avg({b}))", round(d{i} / pars, 9) AS "avg(std({b}))"' for i, b in enumerate(_BASES))}, "avg(average_sentence_length)", "std(average_sentence_length)", "avg(syntactic_complexity_average)", "std(syntactic_complexity_average)" FROM a1 JOIN a2 USING (doc_id, atom_num)"""
PAIRWISE = f"""WITH {BASE}, {TRUTH_CTE}, names AS (SELECT DISTINCT feature FROM long), pr AS (SELECT a.feature AS a, b.feature AS b FROM names a JOIN names b ON a.feature < b.feature),
each AS (SELECT doc_id || ' ' || a || ' ' || b AS pair, atom_num, feature, value FROM long JOIN pr ON feature = a OR feature = b), {outlier("each", "pair")},
j AS (SELECT split_part(pair, ' ', 2) AS feature_a, split_part(pair, ' ', 3) AS feature_b, truth AS actual, round(confidence, 9) AS confidence FROM scored s JOIN truth t ON t.doc_id = CAST(split_part(pair, ' ', 1) AS BIGINT) AND t.atom_num = s.atom_num)
SELECT feature_a, feature_b, auc FROM ({auc('j', 'feature_a, feature_b')})"""
SAME_DOCUMENT = f"""WITH {BASE}, h AS (SELECT *, CAST('0x' || substr(md5('1:' || doc_id || ':' || atom_num), 1, 8) AS BIGINT) / 4294967296 < 0.5 AS a FROM long),
g AS (SELECT feature, doc_id, nullif(count(*) FILTER (a), 0) AS na, nullif(count(*) FILTER (NOT a), 0) AS nb, avg(value) FILTER (a) AS ma, avg(value) FILTER (NOT a) AS mb, var_samp(value) FILTER (a) AS va, var_samp(value) FILTER (NOT a) AS vb FROM h GROUP BY ALL)
SELECT feature, doc_id, CASE WHEN abs((ma - mb) / nullif(sqrt(va / na + vb / nb), 0)) < 5e-7 THEN 0.0 ELSE round((ma - mb) / nullif(sqrt(va / na + vb / nb), 0), 6) END AS t,
  round(pow(va / na + vb / nb, 2) / nullif(pow(va / na, 2) / nullif(na - 1, 0) + pow(vb / nb, 2) / nullif(nb - 1, 0), 0), 6) AS freedom FROM g"""
OVERLAPS = f"""WITH {_JUDGED}, d AS (SELECT DISTINCT t.doc_id, t.s, t.e FROM truth t JOIN ext USING (doc_id, atom_num) WHERE confidence > 0.2), o AS (SELECT DISTINCT doc_id, s, e FROM occ),
r AS (SELECT d.doc_id, 'detected' AS kind, d.s, d.e, sum(CASE WHEN o.s < d.e AND o.e > d.s THEN least(d.e, o.e) - greatest(d.s, o.s) END) AS c FROM d LEFT JOIN o USING (doc_id) GROUP BY ALL UNION ALL SELECT o.doc_id, 'true', o.s, o.e, sum(CASE WHEN o.s < d.e AND o.e > d.s THEN least(d.e, o.e) - greatest(d.s, o.s) END) FROM o LEFT JOIN d USING (doc_id) GROUP BY ALL)
SELECT doc_id, kind, s AS start, e AS "end", CAST(coalesce(c, 0) AS BIGINT) AS covered FROM r"""
WEIGHTED = f"WITH {BASE.replace('long AS (', 'plain AS (')}, long AS (SELECT doc_id, atom_num, feature, value * CASE feature WHEN 'average_syllables_per_word' THEN 2.0 WHEN 'stopword_percentage' THEN 3.0 ELSE 1.0 END AS value FROM plain), {outlier()} SELECT doc_id, atom_num, round(confidence, 6) AS confidence FROM scored"
SINK_PASSAGES = f"""WITH {TEXTS}, {tokens()}, {nchars(500)}, {CLASSES}, {ATOM_WORDS}, {TRUTH_CTE}, w AS (SELECT doc_id, atom_num, CAST(sum(e - s) AS DOUBLE) AS num_chars, round(sum(e - s) / count(*), 6) AS average_word_length FROM aw GROUP BY ALL)
SELECT doc_id, s AS start_index, e AS end_index, num_chars, average_word_length, round(num_chars / 1000, 6) AS plag_confidence, CAST(truth AS INTEGER) AS contains_plag FROM w JOIN truth USING (doc_id, atom_num)"""
UPSERTED = "SELECT doc_id, quality FROM labels WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
