"""Plain Python models of the operators, for small inputs."""

from itertools import groupby


def history(events, every_seq=True, close=False):
    """``events``: (key, seq, tie, value, kind) -> (key, value, start, end) rows."""
    kept = [e for e in events if e[4] != "update_preimage" and (close or e[4] != "delete")]
    winners = {}
    for e in kept:
        if (e[0], e[1]) not in winners or e[2] > winners[e[0], e[1]][2]:
            winners[e[0], e[1]] = e
    out = []
    ordered = sorted(winners.values(), key=lambda e: (e[0], e[1]))
    for key, group in groupby(ordered, lambda e: e[0]):
        versions = []
        for e in group:
            state = (e[3], e[4] == "delete")
            if every_seq or not versions or versions[-1][0] != state:
                versions.append((state, e[1]))
        for i, ((value, gone), start) in enumerate(versions):
            end = versions[i + 1][1] if i + 1 < len(versions) else None
            if not gone:
                out.append((key, value, start, end))
    return sorted(out, key=repr)


def left_join_all(keys, *tables):
    """Chained left joins; tables are lists of (key, value)."""
    result = [(k,) for k in keys]
    for table in tables:
        step = []
        for row in result:
            hits = [v for k, v in table if k is not None and k == row[0]]
            step += [(*row, v) for v in hits] or [(*row, None)]
        result = step
    return sorted(result, key=repr)
