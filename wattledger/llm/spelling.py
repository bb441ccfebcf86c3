"""Spelling variants: words one edit apart, grouped under the much more frequent form.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The pair is found by
asymmetric chunks: the shorter word (of equal ones the smaller) contributes its two disjoint halves, the longer one its
positional grams of that size. One edit cannot touch both halves, so one of them is a gram of the other word, moved by
one place at most; grams that no chunk within one place can meet are not made. The half with the edit is treated in the
same way once more, which keeps the keys rare. Candidates are verified by their edit distance. Everything is a DataFrame
expression.

Null texts have no words. Of a row without an id no code point is deleted, as its checksum is null. Repeated rows count
each. Words without a near word keep ``form`` null and are their own root. Long texts are split whole; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.staging import stage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, DELETE_EVERY = 6, 5, 5, 199


def word_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: every maximal run of letters of every text, A-Z in lower case."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1))
    return docs.select("doc_id", F.explode(runs).alias("run"))


def misspell(runs: DataFrame, every: int = DELETE_EVERY) -> DataFrame:
    """``word``: the runs; of those whose checksum with the document's id ``every`` divides, less one code point."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words long and frequent enough. Counted in the tasks first."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column, shorter: Column) -> Column:
    """Grams of a word at the places where the chunks of a word of ``shorter`` code points, one edit away, lie in it.

    The edit leaves one half of the shorter word whole: the first one, which then stays at its place, or the second one,
    which moves by the difference in length. The half that holds the edit is halved again in the same way, and a quarter
    of it stays beside. A key is the whole half, the whole quarter, and which they are. For the shorter word itself these
    are its chunks.
    """
    half = F.floor(shorter / 2).cast("int")
    quarter = F.floor((shorter - half) / 2).cast("int")
    size = F.length(word)
    rest = size - half  # code points outside the half
    out = []
    for side, at, first, last in (("<", F.lit(1), half + 1, size - quarter + 1), (">", rest + 1, F.lit(1), rest - quarter + 1)):
        for part, place in (("<", first), (">", last)):
            out.append(F.struct(F.lit(side + part).alias("which"), F.substr(word, at, half).alias("half"), F.substr(word, place, quarter).alias("quarter")))
    return F.array(*out)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of ``words(word, n)`` one edit apart, in both directions."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("s"), F.col("n").alias("s_n"), size.alias("of"), F.inline(_keys(F.col("word"), size)))
    sized = words.select(F.col("word").alias("t"), F.col("n").alias("t_n"), F.explode(F.array(size, size - 1)).alias("of"))
    grams = sized.select("t", "t_n", "of", F.inline(_keys(F.col("t"), F.col("of"))))
    ordered = (F.length("t") > F.col("of")) | (F.col("s") < F.col("t"))
    met = chunks.join(grams, ["of", "which", "half", "quarter"]).where(ordered)
    pairs = met.where(F.levenshtein("s", "t", 1) == 1).select("s", "s_n", "t", "t_n").distinct()
    both = F.array(F.struct(F.col("s").alias("word"), F.col("s_n").alias("n"), F.col("t").alias("near"), F.col("t_n").alias("near_n")),
                   F.struct(F.col("t").alias("word"), F.col("t_n").alias("n"), F.col("s").alias("near"), F.col("s_n").alias("near_n")))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, where a form is more frequent than its word, so that no path returns.

    Pointer doubling: each round doubles the steps that a word has gone.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stage(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def spelling_forms(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, delete_every: int = DELETE_EVERY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs(doc_id, text)``."""
    words = stage(count_words(misspell(word_runs(docs), delete_every), min_length, min_count), "words")
    best = near_words(words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = stage(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    out = words.join(formed, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


#: Near words here come from deletions alone: a longer word less one code point, or two words equal but for one place.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 | (ord(x) >> 6), 128 | (ord(x) & 63)] END)) AS b FROM runs),
sums AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
results AS (
  SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM sums),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(times) >= {MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS near FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, p.near) AS near, max(w.n) AS near_n
  FROM pairs p JOIN words w ON w.word = p.near GROUP BY 1),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * words.n THEN near END AS form,
    CASE WHEN near_n >= {TIMES} * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON forms.word = path.place WHERE forms.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(place, step) FROM path WHERE path.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
