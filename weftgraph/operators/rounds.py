"""repeat(): rounds of the body over a frontier, until it is empty or ``times`` are made.

Before each round a traverser leaves if it has made ``times`` rounds or meets ``until``. Without emit, one
that the body leads nowhere leaves as it is. With emit, every result of a round also leaves (if it meets
the emit condition); ``emit_first`` lets the inputs leave as well. A traverser that both emit and until
let go leaves once. Each round's results are settled, so the plan doesn't grow; empty ones aren't kept.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import count

from pyspark.sql import functions as F

from weftgraph.functions.predicates import P
from weftgraph.plans.traversal import Step, Traversal
from weftgraph.runtime import Rounds


def _test(a) -> Traversal:
    return a if isinstance(a, Traversal) else Traversal(None, (Step("is", (a if isinstance(a, P) else P.eq(a),)),))


def repeated(s, step: Step):
    from weftgraph.operators.execute import keep, together, walk

    mods: dict[str, tuple] = {}
    for name, args in step.mods:
        mods[name] = args
    times = mods["times"][0] if "times" in mods else None
    until = _test(mods["until"][0]) if "until" in mods else None
    emit = "emit" in mods or "emit_first" in mods
    emit_args = mods.get("emit") or mods.get("emit_first") or ()
    chosen = _test(emit_args[0]) if emit_args else None
    body = step.args[0]
    if times is None and until is None and not emit:
        raise ValueError("repeat() needs times, until or emit")

    def picked(x):
        return keep(x, chosen) if chosen is not None else x

    rounds = Rounds()

    def leave(x):
        df, some = rounds.settle(x.df)
        if some or not out:
            out.append(replace(x, df=df))

    now = replace(s, df=s.df.withColumn("_loops", F.lit(0).cast("long")))
    out: list = []
    if "emit_first" in mods:
        out.append(picked(now))
    for n in count() if times is None else range(times + 1):
        if times is not None and n >= times:
            if not emit or (n == 0 and "emit_first" not in mods):
                out.append(now)
            break
        if until is not None:
            done = keep(now, until)
            if not emit or (n == 0 and "emit_first" not in mods):
                leave(done)
            elif chosen is not None:
                leave(keep(done, chosen, anti=True))
            now = keep(now, until, anti=True)
        if not emit:
            leave(keep(now, body, anti=True))
        after = walk(now, body.steps)
        after = replace(after, df=after.df.withColumn("_loops", F.lit(n + 1).cast("long")))
        df, some = rounds.settle(after.df)
        after = replace(after, df=df)
        if emit and (some or not out):
            out.append(picked(after))
        now = after
        if (times is None or n + 1 < times) and not some:
            break
    return together(out)
