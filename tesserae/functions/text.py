
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, WINDOW = 50, 80
#: What Python's str.strip() removes.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Openers by which an answer abstains.
ABSTAIN = r"(?iuU)\b(i don'?t (know|have)|i do not (know|have)|i'?m not (sure|familiar|aware)|i am not (sure|familiar|aware)|not familiar with|no (reliable )?(information|data|record)|can'?t (confirm|verify|find)|cannot (confirm|verify|find)|couldn'?t find|could you (clarify|provide)|not enough information)\b"
# Phrases by which a reply accepts a correction.
ACCEPT = r"(?iuU)you'?re right|you are right|my mistake|i was wrong|i got (that|it) wrong|i had (that|it) wrong|good catch|thanks for|thank you for|i stand corrected|apolog|my error|i made (a|an) (mistake|error)|correction"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a column that only a lambda uses would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column | str) -> Column:
    """Only A-Z: lower() would also turn the Kelvin sign into an ASCII k."""
    return F.translate(as_col(c), UPPER, LOWER)


def norm(c: Column | str) -> Column:
    """[S1] Lower-case ASCII words and digits joined by single spaces; null stays null."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), EDGES, "")


def collapse(c: Column | str) -> Column:
    """[S13] White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), r"(?U)[\s\x1c-\x1f]+", " ")))


def probes(normalised: Column | str) -> Column:
    """[S2] Probes of a normalised text: none under 50 characters, the whole under 160, else its first and last 80."""
    n = as_col(normalised)
    both = F.array(F.trim(F.substring(n, 1, WINDOW)), F.trim(F.right(n, F.lit(WINDOW))))
    return F.when(F.length(n) < MIN_LENGTH, F.array().cast("array<string>")).when(F.length(n) < 2 * WINDOW, F.array(n)).otherwise(both)


def split_key(question: Column | str) -> Column:
    """[S5] The first probe of a question, by which sample logs name it."""
    n = norm(question)
    return F.when(F.length(n) < 2 * WINDOW, n).otherwise(F.trim(F.substring(n, 1, WINDOW)))


def context(normalised: Column | str, pattern: Column | str) -> Column:
    """[S4] The stretch from 200 characters before to 120 after the last character of the first occurrence."""
    n, p = as_col(normalised), as_col(pattern)
    end = F.instr(n, p) + F.length(p) - 2
    begin = F.greatest(F.lit(0), end - 200)
    return n.substr(begin + 1, end + 120 - begin)


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def grade(answer: Column | str, golds: Column | str) -> Column:
    """[S6] right, abstain or wrong, by word-bounded containment of any gold of two characters or more."""
    a = padded(as_col(answer))
    hit = F.exists(as_col(golds), lambda g: (F.length(F.trim(g)) >= 2) & F.contains(a, padded(g)))
    return F.when(hit, "right").when(as_col(answer).rlike(ABSTAIN), "abstain").otherwise("wrong")


def accepts(c: Column | str) -> Column:
    """[A11] Whether a reply gives in."""
    return as_col(c).rlike(ACCEPT)


def answer_line(c: Column | str) -> Column:
    """[S9] What follows `answer:` on the last line that begins so, or null."""
    lines = F.filter(F.split(as_col(c), "\n"), lambda x: F.lower(F.trim(x)).startswith("answer:"))
    return F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), "(?i)^\\s*answer:", ""))


def answer_norm(c: Column | str, exact: bool = False) -> Column:
    """[S8] A mathematical answer without dressing; a number in shortest form of six significant digits, or if exact of all
    its digits."""
    s = strip(c)
    for old in ("\\boxed", "\\text", "$", "{", "}", " ", ","):
        s = F.replace(s, F.lit(old), F.lit(""))
    s = F.lower(F.replace(F.replace(s, F.lit("\\dfrac"), F.lit("\\frac")), F.lit("\\tfrac"), F.lit("\\frac")))
    s = F.regexp_replace(s, r"^\.+(?![0-9])|\.+$", "")
    short = lambda x: F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")
    if exact:
        led = F.regexp_replace(F.regexp_replace(s, r"^\+?0+(?=[0-9])|^\+|(?<=^-)0+(?=[0-9])", ""), r"(?<=^-?)(?=\.)", "0")
        plain = F.when(F.contains(led, F.lit(".")), short(led)).otherwise(led)
        return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.when(plain == "-0", "0").otherwise(plain)).otherwise(s)
    number = s.try_cast("double")
    digits = F.when(number == 0, 0.0).otherwise(F.round(number / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(number))) - 5)) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(number))) - 5))
    return F.when(number.isNotNull() & (F.abs(number) < 1e12), short(F.format_string("%.10f", digits))).otherwise(s)


def boxed(c: Column | str) -> Column:
    """[S7] The content of the last \\boxed{...} whose braces balance, or null. One pass over the characters."""
    tail = F.element_at(F.split(as_col(c), r"\\boxed\{"), -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))
    step = lambda s, x: F.when(s["depth"] == 0, s).otherwise(
        F.struct(
            (s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"),
            F.when((x == "}") & (s["depth"] == 1), s["out"]).otherwise(F.concat(s["out"], x)).alias("out"),
        )
    )
    end = F.aggregate(F.split(tail, ""), start, step)
    return F.when(F.contains(as_col(c), F.lit("\\boxed{")) & (end["depth"] == 0), end["out"])


def first_sentence(c: Column | str) -> Column:
    """[S10] The first sentence of the first line."""
    line = F.element_at(F.split(strip(c), "\n"), 1)
    cut = F.regexp_extract(line, r"(?U)^(.*?[.!?])\s", 1)
    return F.trim(F.when(cut == "", line).otherwise(cut))


def clean_dashes(c: Column | str) -> Column:
    """[S11] Spaced dashes become commas."""
    return F.trim(F.regexp_replace(as_col(c), r"\s*[\u2013\u2014]\s+|\s+[\u2013\u2014]\s*", ", "))


# Notes about format instructions in reasoning traces.
META = r"""(?iuU)em dash|last line|final line|'answer:|"answer:|answer: \.\.\.|need final|system prompt|instruction"""


def without_meta(c: Column | str, meta: str = META) -> Column:
    """[S12] Sentences and lines that match a pattern are dropped, and blank ones."""
    parts = F.split(clean_dashes(c), r"(?<=[.!?])\s+|\n")
    return F.trim(F.array_join(F.filter(parts, lambda x: (strip(x) != "") & ~x.rlike(meta)), " "))


def item_text(question: Column | None = None, context: Column | None = None, options: Column | None = None, label: Column | None = None) -> Column:
    """[S3] A benchmark item's text: the question, or the context and the option that its label (from 0) names."""
    return question if question is not None else F.concat(context, F.lit(" "), F.element_at(options, label.cast("int") + 1))


def json_slice(c: Column | str) -> Column:
    """[S21] From the first { to the last }."""
    return F.regexp_extract(as_col(c), r"(?s)\{.*\}", 0)


def paragraphs(c: Column | str) -> Column:
    """[S22] Blocks between blank lines, or lines if there are fewer than 20 blocks; trimmed, without empty ones."""
    tidy = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    blocks = tidy(F.split(as_col(c), r"\n\s*\n"))
    return F.when(F.size(blocks) < 20, tidy(F.split(as_col(c), "\n"))).otherwise(blocks)


def sentences(c: Column | str) -> Column:
    """[S23] Sentences that end in . ! or ? before white space and a capital letter."""
    return F.split(F.regexp_replace(as_col(c), "([.!?])[ \\t\\n\\r\\f\\x0B]+([A-Z])", "$1\u0001$2"), "\u0001")


def occurrences(text: Column | str, part: Column | str) -> Column:
    """[S24] How often part occurs, without overlaps."""
    t, p = as_col(text), as_col(part)
    return F.when(F.length(p) == 0, 0).otherwise((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.greatest(F.length(p), F.lit(1))).cast("long")


def clear_winner(options: Column, margin: int = 2) -> Column:
    """[S24] Of options (word, n) the word of most occurrences, if it leads the next one by a margin; else null."""
    best = F.sort_array(F.transform(options, lambda o: F.struct(o["n"].alias("n"), o["word"].alias("word"))), False)
    return F.when(F.get(best, F.lit(0))["n"] - F.get(best, F.lit(1))["n"] >= margin, F.get(best, F.lit(0))["word"])


def tokens(c: Column | str) -> Column:
    """[S18] Default token count: runs of ASCII letters and digits, and single other signs."""
    return F.size(F.regexp_extract_all(as_col(c), F.lit("([A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r\\f\\x0B])"), F.lit(1))).cast("long")


def clean_gold(c: Column | str) -> Column:
    """A gold answer of 2 to 60 characters without brackets and pipes, else null."""
    s = strip(c)
    return F.when(F.length(s).between(2, 60) & ~s.rlike(r"[\[\]{}<>|]"), s)


def as_question(c: Column | str) -> Column:
    """[S25] First letter in upper case, a question mark at the end."""
    s = strip(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)), F.when(s.endswith("?"), "").otherwise("?"))
