"""Quality rules: a threshold table compiled into one Spark projection.

Every metric and every rule is a built-in expression over the row, so the whole
operator is a map without a shuffle or a user function. Each document costs a
sort of its own three-word windows and nothing beyond its own length.

Defined cases: null and empty texts have no words and fail the base rules; a
text without white space is one word; repeated rows are judged alike; an empty
table gives an empty table. Metrics are added as one struct column, so columns
of the input keep their names.

The bound on stop words holds only where it can be judged: not for texts mostly
of another script than Latin, nor for labels without a list of stop words; and
the list of a further language may meet it instead, unless the label names one
of the first four.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, let, words_of

#: Frequent function words of the languages judged (fixed values).
STOP_WORDS = (
    "the and of to in is that it for with be are this on as by was from have not "
    "der die das und ist von mit den dem nicht ein eine zu im auf für als sich "
    "le la les de des et est un une que qui en du pour dans pas sur avec "
    "el los las que y en un una por con para no se del lo como"
).split()

#: The labels of these languages.
STOP_LANGUAGES = ("en", "de", "fr", "es")
#: Function words of further languages in Latin script; words that the languages above have, too, don't count.
FURTHER_STOP_WORDS = {
    "pl": "się nie jest oraz że dla jak ale przez przy był była ich tym został",
    "tr": "ve bir bu için ile çok daha olarak olan gibi sonra kadar ancak değil",
    "fi": "ja että hän oli mutta myös kun joka sen sekä ovat ole niin",
    "sv": "och att det som är inte av på till den ett från också",
    "da": "og det der er ikke af til på som fra også blev",
    "no": "og det som er ikke av til på fra også ble",
    "nl": "het een van niet zijn voor aan ook naar maar werd deze wordt",
    "it": "il che di della non è gli nel sono anche più alla delle",
    "pt": "que não uma dos das em mais foi também são pelo ao",
    "cs": "že není jako ale jsou byl také nebo pro jeho při které",
    "sk": "že nie je ako ale sú bol tiež alebo pre jeho pri ktoré",
    "hu": "és hogy nem egy volt csak meg már mint ez azt vagy",
    "ro": "și nu este în care pentru din cu mai fost sunt într",
    "hr": "je nije koji kao ali su od za bio također ili što",
    "id": "yang dan untuk dengan dari ini itu tidak pada adalah dalam",
    "vi": "và của là không được cho trong những một các với này",
}
NO_LABEL = ("", "und", "unknown")


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are shares of words or lines. Documents outside a bound are rejected.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.5),
    Rule("exclamations", "exclaim_ratio", None, 0.5),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("upper_case", "upper_ratio", None, 0.7),
)

METRICS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words mean_word_chars symbol_ratio exclaim_ratio stop_ratio upper_ratio dup_line_ratio"
).split()
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def repeated_positions(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )

    def covered(starts: Column) -> Column:
        return F.size(
            F.array_distinct(
                F.concat(starts, F.transform(starts, lambda p: p + 1), F.transform(starts, lambda p: p + 2))
            )
        )

    def again(grams: Column) -> Column:
        keyed = F.sort_array(F.transform(grams, lambda g, i: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i"))))
        twice = let(
            keyed,
            lambda s: F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                ((k > 0) & F.get(s, k - 1)["g"].eqNullSafe(x["g"]))
                                | F.get(s, k + 1)["g"].eqNullSafe(x["g"])
                            ).alias("d"),
                        ),
                    ),
                    lambda x: x["d"],
                ),
                lambda x: x["i"],
            ),
        )
        distinct = F.size(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))
        return F.when(distinct == F.size(grams), F.lit(0)).otherwise(let(twice, covered))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), again)))


def measure(text: Column) -> Column:
    """All metrics of a text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_SPACE))

    def of(w: Column, ls: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        dup = (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
        share = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
        stop = F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()"))).isin(STOP_WORDS)))
        upper = F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x))))
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup.alias("n_dup_lines"),
            repeated_positions(w).cast("long").alias("n_repeat_words"),
            share(chars).alias("mean_word_chars"),
            share(F.regexp_count(whole, F.lit(r"[#*$%&|<>]"))).alias("symbol_ratio"),
            share(F.regexp_count(whole, F.lit("!"))).alias("exclaim_ratio"),
            share(stop).alias("stop_ratio"),
            share(upper).alias("upper_ratio"),
            F.coalesce(F.try_divide(dup, F.size(ls)), F.lit(0.0)).alias("dup_line_ratio"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: of(w, ls)))


def stop_words_unjudged(text: Column, label: Column, low: float) -> Column:
    """Whether a text with a share of STOP_WORDS below low is in a language or script that they don't cover."""
    whole = F.coalesce(text, F.lit(""))
    letters, latin = (F.regexp_count(whole, F.lit(p)) for p in (r"\p{L}", r"\p{IsLatin}"))
    code = F.element_at(F.split(F.lower(F.coalesce(label, F.lit(""))), "[-_]"), 1)

    def met(w: Column) -> Column:
        lists = (tuple(sorted(set(words.split()) - set(STOP_WORDS))) for words in FURTHER_STOP_WORDS.values())
        reached = lambda own: F.size(F.filter(w, lambda x: x.isin(*own))) >= low * F.size(w)
        return reduce(lambda a, b: a | b, map(reached, lists))

    plain = F.transform(words_of(text), lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()"))))
    unlisted = ~code.isin(*NO_LABEL, *STOP_LANGUAGES, *FURTHER_STOP_WORDS)
    return unlisted | (2 * latin < letters) | (~code.isin(*STOP_LANGUAGES) & let(plain, met))


def failed_rules(metrics: Column, rules: tuple[Rule, ...] = RULES, unjudged: Callable[[float], Column] = lambda low: F.lit(False)) -> Column:
    """Names of the rules that the metrics break, in the table's order; unjudged: where a lower bound on stop words doesn't hold."""
    checks = []
    for r in rules:
        value, bad = metrics[r.metric], F.lit(False)
        if r.low is not None:
            low = value < r.low
            bad = bad | (low & ~unjudged(r.low) if r.metric == "stop_ratio" else low)
        if r.high is not None:
            bad = bad | (value > r.high)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "quality", lang: str = "lang") -> DataFrame:
    """docs with a struct column `out`: the metrics, base_failed, failed (rule names) and kept; lang: labels, if docs has them."""
    label = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")

    def judged(m: Column) -> Column:
        base = (m["n_words"] < BASE_MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * m["n_words"])
        failed = failed_rules(m, rules, lambda low: stop_words_unjudged(F.col(text), label, low))
        # one expression: a filter on the result evaluates the metrics once
        return F.struct(
            *(m[c].alias(c) for c in METRICS), base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept")
        )

    return docs.withColumn(out, let(measure(F.col(text)), judged))
