"""The definitions written out over plain lists, as the yardstick for small inputs."""

import itertools
import math
from collections import Counter


def itemsets(rows, min_support):
    least = max(math.ceil(min_support * len(rows)), 1)
    counts = Counter()
    for items, _ in rows:
        clean = sorted({i for i in items if i is not None})
        for size in range(1, len(clean) + 1):
            counts.update(itertools.combinations(clean, size))
    return {itemset: n for itemset, n in counts.items() if n >= least}


def split(rows, itemset):
    inside = [t for items, t in rows if set(itemset) <= set(items)]
    outside = [t for items, t in rows if not set(itemset) <= set(items)]
    return inside, outside


def shares(values):
    return {x: n / len(values) for x, n in sorted(Counter(values).items())}


def mean(values):
    return sum(values) / len(values)


def variance(values, ddof):
    m = mean(values)
    return sum((x - m) ** 2 for x in values) / (len(values) - ddof)


def kl(inside, outside):
    p, q = shares(outside), shares(inside)
    return sum(p[x] * math.log(p[x] / q[x]) for x in p if x in q)


def expo_fit(values):
    rate = 1 / mean(values)
    return sum(p * (math.log(p) - math.log(rate) + rate / 2 * (2 * x + 1)) for x, p in shares(values).items())


def expo_kl(inside, outside):
    p, q = 1 / mean(outside), 1 / mean(inside)
    return math.log(p) - math.log(q) + q / p - 1


def normal_fit(values):
    m, v = mean(values), variance(values, 1)
    dist = list(shares(values).items())
    total = 0.0
    for (x, p), (upper, _) in zip(dist, dist[1:]):
        height = math.log(1 / (math.sqrt(v) * math.sqrt(2 * math.pi)))
        total += p * (math.log(p) - (height - 0.5 * ((upper - m) ** 3 - (x - m) ** 3) / (3 * v)))
    return total


def normal_kl(inside, outside):
    vp, vq = variance(outside, 1), variance(inside, 1)
    return 0.5 * ((mean(outside) - mean(inside)) ** 2 / vq**2 + vp**2 / vq**2 + math.log(vq**2 / vp**2) - 1)


def welch_z(inside, outside):
    error = math.sqrt(variance(inside, 0) / len(inside) + variance(outside, 0) / len(outside))
    return (mean(inside) - mean(outside)) / error


def symmetric(left, right):
    def one_way(a, b):
        p, q = shares(a), shares(b)
        return sum((p[x] + 1e-10) * math.log((p[x] + 1e-10) / (q.get(x, 0) + 1e-10)) for x in p)

    return 0.5 * (one_way(left, right) + one_way(right, left))
