"""Operator 9: line-first quality rules, DataFrame operations only.

Each line is judged by itself: it must end as a sentence does, must not be a row of navigation
links or symbols, must not shout, and must not be boilerplate. Failing lines are taken out, and a
document that loses more than ``max_loss`` of its text is rejected. Counts over words, lines and
word windows of the whole text come first and reject by themselves.

One map over the rows: every count is made from arrays within a row, so no key, however frequent,
meets in one task, and nothing is shuffled.

Defined results: a null text counts as empty and has no words, so it fails the base rules; texts of
any length are read whole; repeated rows give equal rows; an empty table gives an empty result;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
#: Characters that count as symbols, that part navigation links, and that may end a line.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·→"
ENDINGS = r"[.!?…。！？:;][\"'”’»)\]*_]*" + SPACE + r"*\z"
#: A line of so many words with a sentence end inside passes although its last sentence was cut off.
INNER_END = r"[.!?…]" + SPACE
CLIPPED_WORDS = 20
#: Phrases of notices, site furniture and licence lines, in English, German, French and Spanish.
BOILERPLATE = [
    "all rights reserved", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "accept cookies", "terms of use", "terms of service", "terms and conditions",
    "enable javascript", "lorem ipsum", "sign in", "log in to", "sign up for", "subscribe to", "newsletter", "click here", "read more", "share this", "follow us", "skip to content", "back to top",
    "licensed under", "released under the", "copyright (c)", "copyright ©",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "nutzungsbedingungen", "jetzt anmelden", "newsletter abonnieren", "hier klicken", "weiterlesen", "zum seitenanfang", "lizenziert unter",
    "tous droits réservés", "politique de confidentialité", "utilise des cookies", "accepter les cookies", "conditions d'utilisation", "cliquez ici", "lire la suite", "suivez-nous", "retour en haut", "sous licence",
    "todos los derechos reservados", "política de privacidad", "utiliza cookies", "aceptar cookies", "términos de uso", "iniciar sesión", "haga clic aquí", "leer más", "síguenos", "volver arriba", "bajo licencia", "bajo la licencia",
]
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOSS = 0.5
MAX_SYMBOL_SHARE = 0.1


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column, marks: Column) -> Column:
    """True if a line passes every line rule.

    ``marks`` has what the whole text has at all (links, symbols, shouts, phrases), so most lines are
    only looked at where they end.
    """
    words = F.size(F.split(F.trim(line), SPACE + "+"))
    navigation = marks.links & (_count(line, SEPARATORS) >= 3) & (_count(line, SEPARATORS) * 5 >= words)
    symbols = marks.symbols & (_count(line, SYMBOLS) > MAX_SYMBOL_SHARE * F.length(line))
    shouting = marks.shouts & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 5 > words)
    phrases = marks.phrases & line.rlike("(?iu)" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE))
    ends = F.right(F.rtrim(line), F.lit(6)).rlike(ENDINGS)
    clipped = line.rlike(INNER_END) & (words >= CLIPPED_WORDS)
    return (ends | clipped) & ~navigation & ~symbols & ~shouting & ~phrases


def _any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def with_rules(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS, out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the counts, base_failed, loss, clean_text and kept.

    A column of that name is replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Arrays that a lambda indexes stand in a projection below it, or each step would make them anew.
    first = {
        "w": F.array_remove(F.split(text, SPACE + "+"), ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "links": _any(text, list(SEPARATORS)),
        "shouts": _any(text, ["!!", "??", "!?", "?!"]),
        "phrases": _any(F.lower(text), BOILERPLATE),
    }
    rows = docs.withColumn(out, F.struct(*(v.alias(k) for k, v in first.items())))
    q = F.col(out)
    word, n = q.w, F.size(q.w)
    window = lambda i: F.struct(F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("h"), i.alias("p"))
    grams = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    second = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(word, "")).cast("long"),
        "n_symbols": q.n_symbols,
        "lines": q.lines,
        "marks": F.struct(q.links.alias("links"), (q.n_symbols > 0).alias("symbols"), q.shouts.alias("shouts"), q.phrases.alias("phrases")),
        "g": grams,
    }
    rows = rows.withColumn(out, F.struct(*(v.alias(k) for k, v in second.items())))
    g = q.g
    twice = F.filter(g, lambda x, k: (F.get(g, k + 1)["h"] == x["h"]) | (F.get(g, k - 1)["h"] == x["h"]))
    third = {c: q[c] for c in ("n_words", "word_chars", "n_symbols", "lines")} | {
        "good": F.filter(q.lines, lambda x: line_passes(x, q.marks)),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))).cast("long"),
    }
    rows = rows.withColumn(out, F.struct(*(v.alias(k) for k, v in third.items())))
    clean_text = F.array_join(q.good, "\n")
    left = F.when(F.size(q.good) == F.size(q.lines), q.word_chars).otherwise(F.length(F.translate(clean_text, BLANKS, "")).cast("long"))
    counts = {c: q[c] for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")} | {
        "n_dup_lines": (F.size(q.lines) - F.size(F.array_distinct(q.lines))).cast("long"),
        "left_chars": left,
        "clean_text": clean_text,
        "base_failed": (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEATED * q.n_words),
        "loss": F.when(q.word_chars > 0, 1 - left / q.word_chars).otherwise(F.lit(0.0)),
    }
    rows = rows.withColumn(out, F.struct(*(v.alias(k) for k, v in counts.items())))
    return rows.withColumn(out, F.struct(f"{out}.*", (~q.base_failed & (q.loss <= max_loss)).alias("kept")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: id, counts, base_failed, loss and kept."""
    rows = with_rules(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", max_loss)
    return rows.select(F.col("id").alias(id_col), *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "loss", "kept")))


def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept documents without their failing lines, with the columns they came with."""
    own = "quality"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    rows = with_rules(docs, text_col, max_loss, own)
    # A number of the row, which is not deterministic, keeps the filter above the projections: moved
    # below them, it would hold the rules again and again, nested.
    rows = rows.withColumn(own, F.struct(f"{own}.*", F.monotonically_increasing_id().alias("row"))).where(f"{own}.kept and {own}.row >= 0")
    text = F.when(F.col(f"{own}.left_chars") < F.col(f"{own}.word_chars"), F.col(f"{own}.clean_text")).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, text)
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)
