"""Features of texts."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import quality, structure
from .registry import SQL, query
from .sql import SENTENCES, WORD_CHARS, count_of, ratio, total, where, words

W = words()
LINES = "string_split(text, chr(10))"


@query(f"SELECT doc_id, len(w) AS docq_total_words, {ratio(total('w'), 'len(w)')} AS docq_mean_word_len, {ratio(where('w', chr(39).join(['contains(x, ', '#', ') OR contains(x, ', '...', ')'])), 'len(w)')} AS docq_symbol_to_word_ratio FROM (SELECT doc_id, {W} AS w FROM documents)")
def doc_quality_words(t):
    return quality.word_statistics(t("documents")).select("doc_id", "docq_total_words", "docq_mean_word_len", "docq_symbol_to_word_ratio")


@query(f"""SELECT doc_id, {ratio(where('l', "starts_with(x, '-') OR starts_with(x, '*')"), 'len(l)')} AS docq_bullet_point_ratio, {ratio(where('l', "suffix(x, '...')"), 'len(l)')} AS docq_ellipsis_line_ratio,
{ratio(where('w', r"regexp_matches(x, '[\p{L}]')"), 'len(w)')} AS docq_alphabet_word_ratio FROM (SELECT doc_id, {LINES} AS l, {W} AS w FROM documents)""")
def doc_quality_lines(t):
    return quality.line_ratios(t("documents")).select("doc_id", "docq_bullet_point_ratio", "docq_ellipsis_line_ratio", "docq_alphabet_word_ratio")


@query(f"SELECT doc_id, {ratio(count_of('text', '{') + ' + ' + count_of('text', '}'), 'length(text)')} AS curly, {count_of('text', 'the')} AS n_the FROM documents")
def doc_quality_ratios(t):
    from ..functions.text import count_of as spark_count

    return t("documents").select("doc_id", quality.curly_bracket_ratio("text").alias("curly"), spark_count("text", "the").alias("n_the"))


@query(f"SELECT doc_id, {SENTENCES} AS sentences FROM documents")
def sentence_count(t):
    return t("documents").select("doc_id", quality.sentence_count("text").alias("sentences"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^{WORD_CHARS}])(?:idiot|moron|clown)(?:$|[^{WORD_CHARS}])') AS bad FROM documents")
def bad_words(t):
    return t("documents").select("doc_id", quality.contains_bad_word("text", ["idiot", "moron", "", "clown"]).alias("bad"))


@query("SELECT doc_id, lang = 'en' AND (" + " + ".join(f"contains(text, '{w}')::INTEGER" for w in quality.COMMON_EN) + ") >= 2 AS common FROM documents")
def common_words(t):
    return t("documents").select("doc_id", quality.contains_common_words("text", F.col("lang")).alias("common"))


_PLAIN = r"""trim(regexp_replace(lower(regexp_replace(text, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""


@query(f"SELECT doc_id, {ratio(count_of('p', 'the a'), 'length(p)')} AS share, {ratio(count_of('p', 'lorem ipsum'), 'length(p)')} AS lorem FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)")
def lorem_ipsum(t):
    from ..functions.text import PUNCT, WS, count_of as spark_count, ratio as spark_ratio, without

    p = F.trim(F.regexp_replace(F.lower(without("text", f"[{PUNCT}]")), WS + "+", " "))
    return t("documents").select("doc_id", spark_ratio(spark_count(p, "the a"), F.length(p)).alias("share"), quality.lorem_ipsum_ratio("text").alias("lorem"))


@query("SELECT doc_id, length(text)::BIGINT AS docq_avg_ja_sentence_len, -1::BIGINT AS docq_first_ja_alphabet_pos FROM documents")
def doc_quality_japanese(t):
    return quality.japanese(t("documents")).select("doc_id", "docq_avg_ja_sentence_len", "docq_first_ja_alphabet_pos")


def _whole_doc_quality() -> str:
    rude = "|".join(structure.RUDE)
    common = " + ".join(f"contains(text, '{w}')::INTEGER" for w in quality.COMMON_EN)
    own = f"""SELECT doc_id, {SENTENCES} AS docq_sentence_count, {ratio(count_of('text', '{') + ' + ' + count_of('text', '}'), 'length(text)')} AS docq_curly_bracket_ratio,
regexp_matches(text, '(?i)(?:^|[^{WORD_CHARS}])(?:{rude})(?:$|[^{WORD_CHARS}])') AS docq_contain_bad_word, ({common}) >= 2 AS docq_contain_common_en_words FROM documents"""
    parts = [SQL["doc_quality_words"], SQL["doc_quality_lines"], own, f"SELECT doc_id, lorem AS docq_lorem_ipsum_ratio FROM ({SQL['lorem_ipsum']})"]
    return "SELECT doc_id, lang, source, n_chars, COLUMNS('docq_.*') FROM documents " + " ".join(f"JOIN ({x}) USING (doc_id)" for x in parts)


@query(_whole_doc_quality())
def doc_quality(t):
    return quality.doc_quality(t("documents"), bad_words=structure.RUDE).drop("text")


_MARKS = {chr(k): v for k, v in quality.PLAIN.items()}
_SINGLE = [k for k, v in _MARKS.items() if len(v) == 1]
_QUOTED = {k: v.replace("'", "''") for k, v in _MARKS.items()}
_SPELLED = functools.reduce(lambda sql, k: f"replace({sql}, '{k}', '{_QUOTED[k]}')", [k for k in _MARKS if k not in _SINGLE], "t")
_SPELLED = f"translate({_SPELLED}, '{''.join(_SINGLE)}', '{''.join(_QUOTED[k] for k in _SINGLE)}')"


@query(rf"""SELECT doc_id, regexp_replace({_SPELLED}, '[\x00-\x1F\x7F-\x9F]', '', 'g') AS plain FROM (SELECT doc_id, regexp_replace(lower(CASE WHEN lang = 'en' THEN strip_accents(x) ELSE x END), '\p{{Nd}}', '0', 'g') AS t
FROM (SELECT doc_id, lang, regexp_replace(text, '^[\s\v\x1C-\x1F\x85\xA0]+|[\s\v\x1C-\x1F\x85\xA0]+$', '', 'g') AS x FROM documents))""")
def normalised_text(t):
    return t("documents").select("doc_id", quality.normalise("text", F.col("lang")).alias("plain"))


_L, _P = r"regexp_split_to_array(text, '\n+')", r"regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n{2,}')"


@query(f"""SELECT doc_id, {ratio('len(l) - len(list_distinct(l))', 'len(l)')} AS dup_line_frac, {ratio(total('l') + ' - ' + total('list_distinct(l)'), 'length(text)')} AS dup_line_char_frac,
{ratio('len(p) - len(list_distinct(p))', 'len(p)')} AS dup_para_frac, {ratio(total('p') + ' - ' + total('list_distinct(p)'), 'length(text)')} AS dup_para_char_frac FROM (SELECT doc_id, text, {_L} AS l, {_P} AS p FROM documents)""")
def dup_line_para(t):
    return quality.repeated_lines(t("documents")).select("doc_id", "dup_line_frac", "dup_line_char_frac", "dup_para_frac", "dup_para_char_frac")


def _top(n: int) -> str:
    grams = f"(SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, {W} AS w FROM documents), unnest(range(1, len(w) - {n - 2})) r(i))"
    return f"(SELECT doc_id, length(g) * k AS c FROM (SELECT doc_id, g, count(*) AS k, min(i) AS f FROM {grams} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) = 1)"


@query("SELECT d.doc_id, " + ", ".join(f"round(coalesce(t{n}.c, 0) / length(text), 6)::DOUBLE AS top_{n}_gram_char_frac" for n in (2, 3, 4)) + " FROM documents d " + " ".join(f"LEFT JOIN {_top(n)} t{n} ON t{n}.doc_id = d.doc_id" for n in (2, 3, 4)))
def top_ngram(t):
    return quality.gram_repetition(t("documents")).select("doc_id", *[f"top_{n}_gram_char_frac" for n in (2, 3, 4)])


@query()
def dup_ngram(t):
    return quality.gram_repetition(t("documents")).drop("text")


_ENDS = " OR ".join(f"suffix(x, {q})" for q in ("'.'", "'?'", "'!'", "'\"'", "''''"))


@query(f"""SELECT doc_id, {ratio(where('l', _ENDS), 'len(l)')} AS frac_line_punct, {ratio(where('l', 'length(x) <= 30'), 'len(l)')} AS short_line_frac,
{ratio(total('f') + ' - ' + total('list_distinct(f)'), "length(replace(text, chr(10), ''))")} AS dup_line_char_frac, {ratio("len(l) - 1", 'len(w)')} AS new_line_ratio
FROM (SELECT *, list_filter(l, lambda x: NOT regexp_full_match(x, '\\s*')) AS f FROM (SELECT doc_id, text, {LINES} AS l, {W} AS w FROM documents))""")
def fineweb_quality(t):
    return quality.line_quality(t("documents")).select("doc_id", "frac_line_punct", "short_line_frac", "dup_line_char_frac", "new_line_ratio")


_RW = r"""list_filter(list_transform({w}, lambda x: regexp_replace(regexp_replace(x, '^[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]+', ''), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]+$', '')), lambda x: x <> '')""".format(w=W)


@query(rf"""SELECT doc_id, round((n + len(list_filter(w, lambda x: length(x) <= 3))) / s, 6)::DOUBLE AS mcalpine_eflaw_textstat, round(4.71 * ch / n + 0.5 * n / s - 21.43, 6)::DOUBLE AS automated_readability_index_textstat,
round(0.0588 * (ch / n * 100) - 0.296 * (s / n * 100) - 15.8, 6)::DOUBLE AS coleman_liau_index_textstat, round(length(regexp_replace(text, '\s', '', 'g')) * 14.69 / 1000, 6)::DOUBLE AS reading_time_textstat
FROM (SELECT doc_id, text, w, greatest(len(w), 1)::DOUBLE AS n, greatest({SENTENCES}, 1)::DOUBLE AS s, {total('w')}::DOUBLE AS ch FROM (SELECT doc_id, text, {_RW} AS w FROM documents))""")
def readability_closed_form(t):
    names = ("mcalpine_eflaw", "automated_readability_index", "coleman_liau_index", "reading_time")
    return quality.readability(t("documents"), scores=names).select("doc_id", *[f"{n}_textstat" for n in names])


_READ = f"""WITH b AS (SELECT doc_id, lang, source, n_chars, text, w, list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - regexp_matches(lower(x), '[^aeiouyl]e$')::INTEGER, 1)) AS y FROM (SELECT *, {_RW} AS w FROM documents)),
c AS (SELECT *, greatest(len(w), 1)::DOUBLE AS n, greatest({SENTENCES}, 1)::DOUBLE AS s, {total('w')}::DOUBLE AS ch, coalesce(list_sum(y), 0)::DOUBLE AS sy, len(list_filter(y, lambda x: x >= 3))::DOUBLE AS poly,
len(list_filter(range(1, len(w) + 1), lambda i: y[i] >= 2 AND NOT list_contains([{', '.join(f"'{x}'" for x in quality.COMMON_EN)}], lower(w[i]))))::DOUBLE AS hard, len(list_filter(w, lambda x: length(x) <= 3))::DOUBLE AS mini FROM b),
d AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * n / s - 84.6::DOUBLE * sy / n AS flesch_ease, 0.39::DOUBLE * n / s + 11.8::DOUBLE * sy / n - 15.59::DOUBLE AS flesch_kincaid, 0.4::DOUBLE * (n / s + 100.0::DOUBLE * poly / n) AS gunning_fog,
CASE WHEN s >= 3 THEN 1.043::DOUBLE * sqrt(30.0::DOUBLE * poly / s) + 3.1291::DOUBLE ELSE 0.0::DOUBLE END AS smog_index, 0.0588::DOUBLE * (ch / n * 100) - 0.296::DOUBLE * (s / n * 100) - 15.8::DOUBLE AS coleman_liau_index,
4.71::DOUBLE * ch / n + 0.5::DOUBLE * n / s - 21.43::DOUBLE AS automated_readability_index, 0.1579::DOUBLE * (100.0::DOUBLE * hard / n) + 0.0496::DOUBLE * n / s + CASE WHEN 100.0::DOUBLE * hard / n > 5 THEN 3.6365::DOUBLE ELSE 0.0::DOUBLE END AS dale_chall_readability_score,
hard AS difficult_words, CASE WHEN (n - poly + 3.0::DOUBLE * poly) / s > 20 THEN (n - poly + 3.0::DOUBLE * poly) / s / 2 ELSE ((n - poly + 3.0::DOUBLE * poly) / s - 2) / 2 END AS linsear_write_formula,
0.121::DOUBLE * n / s + 0.082::DOUBLE * (100.0::DOUBLE * hard / n) + 0.659::DOUBLE AS spache_readability, (n + mini) / s AS mcalpine_eflaw, length(regexp_replace(text, '\\s', '', 'g')) * 14.69::DOUBLE / 1000 AS reading_time FROM c),
e AS (SELECT *, list_concat([round(flesch_kincaid)::INTEGER, ceil(flesch_kincaid)::INTEGER], CASE WHEN flesch_ease >= 90 AND flesch_ease < 100 THEN [5] WHEN flesch_ease >= 80 AND flesch_ease < 90 THEN [6] WHEN flesch_ease >= 70 AND flesch_ease < 80 THEN [7]
WHEN flesch_ease >= 60 AND flesch_ease < 70 THEN [8, 9] WHEN flesch_ease >= 50 AND flesch_ease < 60 THEN [10] WHEN flesch_ease >= 40 AND flesch_ease < 50 THEN [11] WHEN flesch_ease >= 30 AND flesch_ease < 40 THEN [12] ELSE [13] END,
flatten(list_transform([smog_index, coleman_liau_index, automated_readability_index, dale_chall_readability_score, linsear_write_formula, gunning_fog], lambda x: [round(x)::INTEGER, ceil(x)::INTEGER]))) AS g FROM d),
f AS (SELECT *, list_transform(g, lambda x: len(list_filter(g, lambda z: z = x))) AS k FROM e)
SELECT doc_id, lang, source, n_chars, g[list_position(k, list_max(k))]::DOUBLE AS text_standard_textstat, {', '.join(f'round({x}, 6)::DOUBLE AS {x}_textstat' for x in quality.SCORES if x != 'text_standard')} FROM f"""


@query(_READ)
def readability(t):
    return quality.readability(t("documents"), scores=quality.SCORES).drop("text")


_ENDS_P = r"[\n\x0B\f\r\x{0085}\x{2028}\x{2029}]+"
_FLAT, _PARAS = f"regexp_replace(text, '{_ENDS_P}', '', 'g')", f"list_filter(regexp_split_to_array(text, '{_ENDS_P}'), lambda x: x <> '')"


@query(rf"""SELECT doc_id, (length(text) - c)::BIGINT AS num_newlines, len(p)::BIGINT AS num_paragraphs, len(w)::BIGINT AS num_words, length(text)::BIGINT AS num_chars, c::BIGINT AS total_non_newline_chars,
{ratio(total('w'), 'len(w)')} AS avg_word_length, {ratio('c', 'len(p)')} AS avg_paragraph_length_chars, {ratio('len(w)', 'len(p)')} AS avg_paragraph_length_words,
{ratio(r"length(regexp_replace(f, '[^\p{L}\p{N}]', '', 'g'))", 'c')} AS alphanumeric_char_ratio, {ratio(r"length(regexp_replace(f, '[^\p{P}]', '', 'g'))", 'c')} AS punctuation_char_ratio,
{ratio(r"length(regexp_replace(f, '[^\p{S}]', '', 'g'))", 'c')} AS other_symbol_char_ratio, {ratio(count_of('text', '#'), 'len(w)')} AS hashes_word_ratio,
{ratio(where('p', r"regexp_matches(x, '(?:[.][.][.]|[.] [.] [.]|…).{{0,15}}\s*$')".replace('{{', '{').replace('}}', '}')), 'len(p)')} AS ellipsis_ratio, {ratio(where('p', r"regexp_matches(x, '^\s*[●•*-]')"), 'len(p)')} AS bulletpoint_ratio
FROM (SELECT *, length(f)::BIGINT AS c FROM (SELECT doc_id, text, {W} AS w, {_FLAT} AS f, {_PARAS} AS p FROM documents))""")
def enrichment_counts(t):
    names = "num_newlines num_paragraphs num_words num_chars total_non_newline_chars avg_word_length avg_paragraph_length_chars avg_paragraph_length_words alphanumeric_char_ratio punctuation_char_ratio other_symbol_char_ratio hashes_word_ratio ellipsis_ratio bulletpoint_ratio"
    return quality.enrichment(t("documents")).select("doc_id", *names.split())


@query()
def enrichment(t):
    return quality.enrichment(t("documents")).drop("text")


@query("SELECT doc_id, 0.0::DOUBLE AS cjk, 0::BIGINT AS longest_cjk, 0.0::DOUBLE AS arabic FROM documents")
def script_ratios(t):
    return t("documents").select("doc_id", quality.script_ratio("text", "CJK").alias("cjk"), quality.longest_cjk_segment("text").alias("longest_cjk"), quality.script_ratio("text", "Arabic").alias("arabic"))


_LJ = r"list_distinct(" + words(r"""regexp_replace(lower(regexp_replace({c}, '[0-9!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]|\p{{P}}', '', 'g')), '^$', '')""") + ")"


@query(f"WITH l AS (SELECT doc_id, {_LJ.format(c='l[1]')} AS a, {_LJ.format(c='l[2]')} AS b FROM (SELECT doc_id, {LINES} AS l FROM documents) WHERE len(l) >= 2) SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS jaccard FROM l")
def line_jaccard(t):
    two = t("documents").select("doc_id", F.split("text", "\n").alias("l")).where(F.size("l") >= 2)
    return two.select("doc_id", quality.line_jaccard(F.get("l", F.lit(0)), F.get("l", F.lit(1))).alias("jaccard"))


@query(r"SELECT doc_id, round(CASE WHEN o = 0 THEN 1.0 ELSE p / o END, 6)::DOUBLE AS punctuation FROM (SELECT doc_id, length(regexp_replace(text, '[\s\p{P}]', '', 'g')) AS o, length(regexp_replace(text, '[^\p{P}]', '', 'g')) AS p FROM documents)")
def punctuation_ratio(t):
    return t("documents").select("doc_id", quality.punctuation_ratio("text").alias("punctuation"))


@query(r"""WITH c AS (SELECT doc_id, i, u[i] AS c FROM (SELECT doc_id, string_split(regexp_replace(text, '[0-9]', '', 'g'), '') AS u FROM documents), unnest(range(1, len(u) + 1)) t(i)),
r AS (SELECT doc_id, c, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, (c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS new FROM c)),
m AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, run, count(*) AS k FROM r WHERE NOT regexp_matches(c, '^[ \t\n\x0B\f\r]*$') GROUP BY doc_id, run) GROUP BY doc_id)
SELECT doc_id, coalesce(longest, 0)::BIGINT AS longest_run, length(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{FFFD}]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))::INTEGER AS clean_chars FROM documents LEFT JOIN m USING (doc_id)""")
def line_features(t):
    return t("documents").select("doc_id", quality.character_repetition("text").alias("longest_run"), F.length(quality.clean_line("text")).alias("clean_chars"))


@query(f"SELECT doc_id AS id, x AS token, round(k / n, 6)::DOUBLE AS share FROM (SELECT doc_id, x, count(*) AS k, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM (SELECT doc_id, {W} AS w FROM documents)) WHERE n >= 5 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, x) = 1")
def most_common_token(t):
    return quality.most_common_token(t("documents"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]'))::BIGINT AS doc_num_tokens, round(strlen(text) / 1024, 6)::DOUBLE AS doc_size_kbs, length(text)::BIGINT AS doc_num_chars, round(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) / strlen(text), 6)::DOUBLE AS tokens_per_doc_size, round(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) / length(text), 6)::DOUBLE AS tokens_per_doc_num_chars FROM documents WHERE length(text) > 0")
def extreme_tokenized(t):
    docs = t("documents").select("doc_id", "text")
    return quality.extreme_tokenized(docs, structure.tokenize_regex(docs)).drop("text")


@query(r"""SELECT word, count(*) AS count FROM (SELECT unnest(""" + words(r"""regexp_replace(lower(text), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')""") + """) AS word FROM documents) GROUP BY word""")
def word_profile(t):
    return quality.word_profile(t("documents"))
