"""Challenge names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.text import trim_unicode

# The challenge catalog in level order, (slug, keyword).
LEVEL_CATALOG = [
    ("stage-1-01-lru-eviction-debug", "lru"),
    ("stage-1-02-bounded-ring-buffer", "ring"),
    ("stage-1-03-sliding-window-rate-limiter", "ratelimit"),
    ("stage-1-04-crawler-race-fix", "crawler"),
    ("stage-1-05-orm-n-plus-1-fix", "nplus1"),
    ("stage-2-06-leader-election-debug", "leader"),
    ("stage-2-07-vector-clock", "vclock"),
    ("stage-2-08-crdt-convergence-debug", "crdt"),
    ("stage-2-09-worker-pool-deadlock", "pool"),
    ("stage-2-10-goroutine-conn-leak", "connleak"),
    ("stage-3-11-aead-timing-leak-debug", "aead"),
    ("stage-3-12-constant-product-amm", "amm"),
    ("stage-3-13-schnorr-merkle-verify", "schnorr"),
    ("stage-3-14-sqli-proto-pollution", "sqli"),
    ("stage-3-15-obfuscated-loop-debug", "obfloop"),
    ("stage-4-16-online-softmax-block", "softmax"),
    ("stage-4-17-bytecode-constant-fold", "constfold"),
    ("stage-4-18-sweep-and-prune-collision", "sweep"),
    ("stage-4-19-numpy-training-nan", "nan"),
    ("stage-4-20-scheduler-deadlock", "sched"),
]


def resolve_level(name: str | Column, catalog: list[tuple[str, str]] | None = None) -> Column:
    """Canonical slug of a typed level name: slug, keyword, number, unique slug
    prefix; anything else comes back trimmed but unchanged.

    Twenty literal rows, so an expression instead of a join.
    """
    levels = catalog or LEVEL_CATALOG
    slugs = F.array(*[F.lit(s) for s, _ in levels])
    words = F.array(*[F.lit(w) for _, w in levels])
    typed = trim_unicode(name)
    low = F.lower(typed)
    number = F.when(low.rlike(r"^\+?[0-9]{1,18}$"), low.try_cast("bigint"))
    in_range = F.when(number.between(1, len(levels)), number)
    keyword = F.nullif(F.array_position(words, low), F.lit(0).cast("bigint"))
    at = lambda i: F.try_element_at(slugs, i.cast("int"))
    starts = F.filter(slugs, lambda s: s.startswith(low))
    return F.coalesce(
        F.when(F.array_contains(slugs, low), low),
        at(keyword),
        at(in_range),
        F.when(F.size(starts) == 1, F.element_at(starts, 1)),
        typed,
    )
