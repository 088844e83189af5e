"""Connected components of a large graph, by rounds of stars."""

from pyspark.sql import functions as F

from podium.llm.common import stored


def components(edges, max_rounds=60):
    """(node, component) for every node of ``edges`` (a, b): the smallest node it can reach.

    Alternates large stars (every larger neighbour of a node goes to the smallest neighbour) and
    small stars (so do the smaller ones), until all that is left are stars. Each round replaces
    edges and adds none, and is written to the shared folder. A node with very many neighbours is
    reduced by a minimum with partial sums and joined back, never gathered in one task.
    """
    edges = stored(_oriented(edges.select("a", "b")), "edges")
    before = _digest(edges)
    for _ in range(max_rounds):
        edges = stored(_small_star(_large_star(edges)), "edges")
        after = _digest(edges)
        # Nothing moves any more when both stars give the edges they were given.
        if after == before:
            return _labels(edges)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _oriented(edges):
    """Each edge once, the larger node first."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges):
    """An order-free fingerprint of a set of edges."""
    mixed = F.xxhash64("a", "b")
    half = F.lit(2**32)
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.pmod(mixed, half)), F.sum(F.shiftrightunsigned(mixed, 32))
    ).first()
    return tuple(row)


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges):
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    links = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    stars = least.select("a", F.col("m").alias("b"))
    return _oriented(links.unionByName(stars))


def _labels(stars):
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
