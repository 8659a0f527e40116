"""Labels and relation texts as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, which must equal the reference's for right results: objects that are dropped entirely, generic category
#: nouns, and generic modifiers of category labels.
BANNED_OBJECTS = ("appliance", "box", "cardboard box", "container", "counter top", "countertop", "equipment", "device", "furniture", "utensil", "tool", "object", "thing", "home appliance", "kitchenware", "tableware")
GENERIC_NOUNS = ("appliance", "device", "equipment", "utensil", "tool", "object", "thing", "item", "stuff", "kitchenware", "tableware", "furniture")
GENERIC_MODIFIERS = ("kitchen", "home", "household", "electric", "electrical", "generic", "misc")


def spaced(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " ")), "^ | $", "")


def track_label(c: Column) -> Column:
    """Lower case; underscores and hyphens are spaces; runs of spaces are one."""
    return spaced(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-", "  "))


def prior_label(c: Column) -> Column:
    """As ``track_label``, and every other sign but letters and digits is a space."""
    return spaced(F.regexp_replace(track_label(c), "[^a-z0-9 ]+", " "))


def plain_label(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def compatible(instance: Column, prior: Column) -> Column:
    """Whether the prior label's words end the instance label; neither may be empty."""
    a, b = prior_label(instance), prior_label(prior)
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit(" "), b)))


def word_suffixes(c: Column) -> Column:
    """Every word suffix of a label: the keys by which compatible priors are found with an equality join."""
    w = F.split(prior_label(c), " ")
    return F.when(prior_label(c) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " ")))


def variants(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), plain_label), lambda x: x != "")))


def canonical_text(text: Column, labels: Sequence[Column] = ()) -> Column:
    """A relation text without slashes, articles, a trailing endpoint label and with turn or twist as rotate."""
    t = prior_label(F.regexp_replace(F.lower(text), "/", " or "))
    t = spaced(F.regexp_replace(t, "\\b(a|an|the)\\b", " "))
    if labels:
        known = F.array_distinct(F.array(*[prior_label(x) for x in labels]))
        ends = F.filter(known, lambda x: (x != "") & t.endswith(F.concat(F.lit(" "), x)))
        cut = F.coalesce(F.array_max(F.transform(ends, lambda x: F.length(x))) + 1, F.lit(0))
        t = F.substr(t, F.lit(1), F.length(t) - cut)
    return F.when(t.rlike("^(turn|twist)( |$)") & ~t.rlike("^(turn|twist) (on|off)( |$)"), F.regexp_replace(t, "^(turn|twist)", "rotate")).otherwise(t)


def compact(c: Column) -> Column:
    return F.regexp_replace(prior_label(c), " ", "")


def atlas_tag(tag: Column) -> Column:
    """A tag without a leading room name, in the form in which atlas labels are matched."""
    return F.regexp_replace(prior_label(tag), "^(kitchen|bathroom|bedroom|living room) ", "")


def singular(word: Column) -> Column:
    """A light plural rule: es, then s."""
    base2, base1 = F.substr(word, F.lit(1), F.length(word) - 2), F.substr(word, F.lit(1), F.length(word) - 1)
    return F.when(word.endswith("es") & (F.length(word) > 4), F.when(base2.isin(*GENERIC_NOUNS), base2).when(base1.isin(*GENERIC_NOUNS), base1).otherwise(base2)).when(word.endswith("s") & (F.length(word) > 3), base1).otherwise(word)


def generic(c: Column) -> Column:
    """Whether a label names nothing concrete: none, a banned object, a generic noun after at most two generic modifiers, or
    any word before object, thing or item."""
    label = F.coalesce(c, F.lit(""))
    w = F.filter(F.split(label, "\\s+"), lambda x: x != "")
    n = F.size(w)
    last = F.coalesce(singular(F.get(w, n - 1)), F.lit(""))
    only = F.forall(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x: singular(x).isin(*GENERIC_MODIFIERS))
    return (n == 0) | label.isin(*BANNED_OBJECTS) | ((n <= 3) & last.isin(*GENERIC_NOUNS) & only) | ((n == 2) & last.isin("object", "thing", "item"))


def relation_key(relation_id: Column, scene: Column, first: Column, second: Column, description: Column) -> Column:
    given = F.nullif(F.trim(relation_id), F.lit(""))
    return F.coalesce(given, F.concat_ws("|", scene, first, second, description))


def merged_parent(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a)
