"""Quality rules, line first, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules. Lines that fail are taken out, and a
document that loses too much of its text that way is rejected. Blank lines are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, WORD, columns, let, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: A line's words may be followed by this much before its end and still close a sentence.
CLOSED = r"""[.!?;:\x{2026}\x{3002}\x{FF01}\x{FF1F}]['")\]\x{201D}\x{2019}\x{00BB}]*[\x20\x09-\x0D]*\z"""
#: Marks that a long line of prose has inside or at its end.
INSIDE = r"[.!?,;:\x{2026}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF1F}\x{060C}\x{061F}\x{06D4}\x{0964}]"
#: Words of menus in English, French, German and Spanish; a short line of which half or more are such words is navigation.
MENU = (
    r"(?i)\b(?:home|menu|login|log in|sign in|sign up|register|about us|contact|contact us|next|previous|search|sitemap|share|tweet|archive|archives|categories|tags|faq|help"
    r"|accueil|connexion|se connecter|rechercher|suivant|retour|plan du site|aide|partager"
    r"|startseite|anmelden|registrieren|kontakt|impressum|suche|weiter|hilfe|teilen"
    r"|inicio|entrar|registrarse|contacto|buscar|siguiente|anterior|ayuda|compartir)\b"
)
BOILERPLATE = (
    r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|we use cookies|accept cookies|enable javascript"
    r"|javascript is (?:disabled|required)|click here|read more|subscribe (?:now|to our)|lorem ipsum|powered by \w+|skip to (?:main )?content"
    r"|follow us on|share this (?:post|page|article)|leave a (?:comment|reply)|add to cart"
    r"|tous droits r\x{00E9}serv\x{00E9}s|mentions l\x{00E9}gales|politique de confidentialit\x{00E9}|lire la suite|cliquez ici|acceptez? les cookies"
    r"|alle rechte vorbehalten|datenschutzerkl\x{00E4}rung|allgemeine gesch\x{00E4}ftsbedingungen|weiterlesen|hier klicken|cookies akzeptieren"
    r"|todos los derechos reservados|pol\x{00ED}tica de (?:privacidad|cookies)|aviso legal|leer m\x{00E1}s|haga clic aqu\x{00ED}|aceptar (?:las )?cookies)"
)
MIN_WORDS = 50
#: Percent of the words that may lie in repeated 3-word windows.
MOST_REPEATED = 50
#: Percent of a line's characters that may be symbols.
MOST_SYMBOLS = 10
#: Percent of a document's characters that its failed lines may take away.
MOST_LOST = 50
#: Lines without a closing mark fail from this many words on only if they also shout or list.
LONGEST_HEADING = 12
#: Positions below this fit the packed form in `_repeated`.
PACKED = 2**24


def _chars(text: Column) -> Column:
    """Characters that aren't blanks."""
    return F.length(F.translate(text, BLANKS, ""))


def _symbols(text: Column, which: str = SYMBOLS) -> Column:
    return F.length(text) - F.length(F.translate(text, which, ""))


def punctuation_fails(line: Column, words: Column) -> Column:
    """Too many symbols, a run of marks after word upon word, or a long line without a mark inside or at its end."""
    symbols = F.lit(100) * _symbols(line) > F.lit(MOST_SYMBOLS) * _chars(line)
    shouts = F.lit(2) * F.regexp_count(line, F.lit(r"[!?]{2}")) > words
    loose = (words > LONGEST_HEADING) & ~line.rlike(INSIDE)
    return symbols | shouts | loose


def navigation_fails(line: Column, words: Column) -> Column:
    """Cells between bars or arrows, or a short open line made of menu words."""
    bars = _symbols(line, "|>»›•")
    menu = (words <= LONGEST_HEADING) & ~line.rlike(CLOSED) & (F.lit(2) * F.regexp_count(line, F.lit(MENU)) >= words)
    return ((bars >= 2) & (F.lit(4) * bars >= words)) | menu


def boilerplate_fails(line: Column) -> Column:
    return line.rlike(BOILERPLATE)


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; one without words breaks none."""
    return let(F.regexp_count(line, F.lit(WORD)), lambda words: (words > 0) & (punctuation_fails(line, words) | navigation_fails(line, words) | boilerplate_fails(line)))


def _repeated(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted as plain numbers first: 40 bits of hash above 24 bits of position. Only
    windows whose 40 bits meet another's are compared as strings; texts with more positions than 24 bits
    hold compare all of theirs. Words have no spaces, so the joined string is the window.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def pack(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-PACKED)).bitwiseOR(i.cast("long"))

    packed = F.sort_array(F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), pack))

    def near(all_: Column) -> Column:
        def meets(x: Column, i: Column) -> Column:
            same = lambda y: F.shiftright(x, 24) == F.shiftright(y, 24)
            return F.coalesce(same(F.get(all_, i - 1)), F.lit(False)) | F.coalesce(same(F.get(all_, i + 1)), F.lit(False))

        return F.transform(F.filter(all_, meets), lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int"))

    every = F.sequence(F.lit(0), n - 3)
    places = F.when(n < 3, F.array().cast("array<int>")).when(n < PACKED, let(packed, near)).otherwise(every)
    pairs = F.array_sort(F.transform(places, lambda i: F.struct(window(i).alias("s"), i.alias("i"))))

    def starts(all_: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda y: F.coalesce(x["s"] == y["s"], F.lit(False))
            return same(F.get(all_, i - 1)) | same(F.get(all_, i + 1))

        return F.sort_array(F.transform(F.filter(all_, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(pairs, starts), covered)


def clean(docs: DataFrame) -> DataFrame:
    """Judge every document; `clean_text` is its text without the lines that fail.

    A null text is like an empty one: no words, base_failed, cleaned to an empty text. Null ids and repeated
    rows are judged like others, an empty table gives no rows, extra columns are not carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = columns(docs, doc_id="long", text="string").select("doc_id", text.alias("text"))
    row = row.select("doc_id", "text", let(F.filter(F.split(F.col("text"), SPACES), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("of_words"), let(F.split(F.col("text"), "\n", -1), lambda ls: F.struct(
        let(F.filter(ls, lambda x: x.rlike(WORD)), lambda full: (F.size(full) - F.size(F.array_distinct(full))).cast("long")).alias("n_dup_lines"),
        F.array_join(F.filter(ls, lambda x: ~line_fails(x)), "\n").alias("clean_text"),
    )).alias("of_lines"))
    out = row.select(
        "doc_id",
        F.col("of_words.n_words").alias("n_words"),
        _chars(F.col("text")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).cast("long").alias("n_symbols"),
        F.col("of_lines.n_dup_lines").alias("n_dup_lines"),
        F.col("of_words.n_repeat_words").alias("n_repeat_words"),
        F.col("of_lines.clean_text").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    out = out.withColumn("lost_chars", F.col("word_chars") - _chars(F.col("clean_text")).cast("long")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.lit(100) * F.col("lost_chars") <= F.lit(MOST_LOST) * F.col("word_chars")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).drop("clean_text")


_W = r"[^\x20\x09-\x0D]"
_MENU_SQL, _BOILER_SQL = MENU.replace("'", "''"), BOILERPLATE.replace("'", "''")
_CLOSED_SQL = CLOSED.replace("'", "''")
OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_W}')) AS ls
  FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) t(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
judged AS (
  SELECT doc_id, l, len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(regexp_extract_all(l, '{_W}+')) AS n,
         len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(l, '[|>\x{{00BB}}\x{{203A}}\x{{2022}}]')) AS bars,
         len(regexp_extract_all(l, '[!?]{{2}}')) AS shouts
  FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
lost AS (
  SELECT doc_id, sum(chars)::BIGINT AS n FROM judged
  WHERE 100 * symbols > {MOST_SYMBOLS} * chars OR 2 * shouts > n OR (n > {LONGEST_HEADING} AND NOT regexp_matches(l, '{INSIDE}'))
     OR (bars >= 2 AND 4 * bars >= n)
     OR (n <= {LONGEST_HEADING} AND NOT regexp_matches(l, '{_CLOSED_SQL}') AND 2 * len(regexp_extract_all(l, '{_MENU_SQL}')) >= n)
     OR regexp_matches(l, '{_BOILER_SQL}')
  GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept
FROM base
"""
