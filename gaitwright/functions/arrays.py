"""Functions of array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return total(F.transform(a, lambda x: x.cast("double"))) / F.size(a)


def correlation(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Pearson of two arrays; 0 where either is nearly flat."""
    ma, mb = mean(a), mean(b)
    x, y = F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb)
    below = norm(x) * norm(y)
    return F.when(below < eps, 0.0).otherwise(dot(x, y) / below)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def distance_label(target: Column, n: int, width: float = 1.0) -> Column:
    """Soft label over ``n`` classes that falls off with the distance from the target."""
    return softmax(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: -F.abs(k - target) / width))


def argmax(a: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def running_product(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.aggregate(F.slice(a, 1, i), F.lit(1.0), lambda s, x: s * x))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x.cast("double"))))


def ordinal_rank(logits: Column) -> Column:
    """Class of a chain of conditional logits: how many cumulated probabilities exceed one half."""
    return F.size(F.filter(running_product(sigmoid(logits)), lambda p: p > 0.5))


def ordinal_probabilities(logits: Column, least: float = 1e-6) -> Column:
    """Class probabilities of such a chain, none under ``least``, adding up to 1."""
    up = running_product(sigmoid(logits))
    raw = F.zip_with(F.concat(F.array(F.lit(1.0)), up), F.concat(up, F.array(F.lit(0.0))), lambda a, b: F.greatest(a - b, F.lit(least)))
    return F.transform(raw, lambda x: x / total(raw))


def expected_value(logits: Column, low: float, high: float) -> Column:
    """Softmax expectation over bin centres spread evenly from ``low`` to ``high``."""
    n = F.size(logits)
    centres = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lit(low) + k * (F.lit(high - low) / (n - 1)))
    return dot(softmax(F.transform(logits, lambda x: x.cast("double"))), centres)


def bounded_value(logits: Column, residual: Column, low: float, high: float, step: float) -> Column:
    """:func:`expected_value` and a residual that moves it by less than one ``step`` of the bins."""
    if step <= 0 or high <= low:
        raise ValueError("a step is positive and high is above low")
    return expected_value(logits, low, high) + F.lit(float(step)) * F.tanh(residual.cast("double"))


def bin_of(target: Column, low: float, high: float, step: float) -> Column:
    """The bin nearest to a target, held inside; halves go to the even bin."""
    return F.greatest(F.lit(0), F.least(F.lit(round((high - low) / step)), F.bround((target - low) / step, 0).cast("int")))


def holds(a: Column, part: Column) -> Column:
    """First place, from 1, at which an array has a sub-sequence; 0 if nowhere."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - F.size(part) + 1)), lambda i: F.slice(a, i, F.size(part)) == part)
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0))


# ---- losses and pooling ----------------------------------------------------------------------


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    rest = F.log(total(F.transform(a, lambda x: F.exp(x - top)))) + top
    return F.transform(a, lambda x: x - rest)


def soft_label_loss(logits: Column, target: Column, n: int, width: float, weights: Column | None = None) -> Column:
    """Cross-entropy against a label that falls off with the distance from the target, times the target's
    weight of ``weights``, an array by class."""
    loss = -dot(distance_label(target, n, width), log_softmax(logits))
    return loss if weights is None else loss * F.element_at(weights, target.cast("int") + 1)


def huber(error: Column, delta: float = 1.0) -> Column:
    e = F.abs(error)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def binary_loss(logit: Column, hit: Column) -> Column:
    """Cross-entropy of a logit, without overflow; ``hit`` is 0 or 1."""
    return F.greatest(logit, F.lit(0.0)) - logit * hit + F.log1p(F.exp(-F.abs(logit)))


def ordinal_losses(logits: Column, target: Column, weights: Column | None = None) -> Column:
    """Of each conditional logit of a chain its loss for a class, null where the target is not above the class
    before: those rows say nothing about it. ``weights`` has one weight for each class, taken by the target."""
    weight = F.lit(1.0) if weights is None else F.element_at(weights, target.cast("int") + 1)
    loss = lambda x, k: binary_loss(x.cast("double"), (target > k).cast("int")) * weight
    return F.transform(logits, lambda x, k: F.when((k == 0) | (target > k - 1), loss(x, k)))


def attention_pool(features: Column, scores: Column) -> Column:
    """Weighted mean (softmax of the scores), mean and maximum of equally long vectors, one after the other."""
    w = softmax(F.transform(scores, lambda s: s.cast("double")))
    at = lambda f: F.transform(F.sequence(F.lit(0), F.size(features[0]) - 1), f)
    column = lambda i: F.transform(features, lambda v: v[i].cast("double"))
    return F.concat(at(lambda i: dot(column(i), w)), at(lambda i: mean(column(i))), at(lambda i: F.array_max(column(i))))


def evenly(low: Column, high: Column, n: int) -> Column:
    """``n`` values from ``low`` to ``high``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + (high - low) * k / (n - 1))


def place_in(a: Column, x: Column) -> Column:
    """How many values of a sorted array are less than ``x``."""
    return F.size(F.filter(a, lambda v: v < x))


def with_defaults(given: Column, defaults: Column) -> Column:
    """A map with what ``given`` lacks taken from ``defaults``."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), F.coalesce(given, F.map_from_arrays(F.slice(F.map_keys(defaults), 1, 0), F.slice(F.map_values(defaults), 1, 0))))
