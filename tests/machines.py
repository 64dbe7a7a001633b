"""Small plain-Python state machines that say what the operators must return."""


def sequence_matches(rows, within, steps):
    """rows: (pos, tie, flags) of one key; flags is the set of step indexes the row satisfies."""
    runs, out = [], []
    for pos, tie, flags in sorted(rows):
        runs = [r for r in runs if pos - r[0][0] < within]
        done = None
        for run in runs:
            if len(run) in flags:
                run.append((pos, tie))
                if len(run) == steps and done is None:
                    done = run
        if 0 in flags:
            runs.append([(pos, tie)])
        if done is not None:
            out.append(tuple(done))
            runs = []
    return out


def gaps(rows, threshold_seconds):
    """rows: (arrival, ms) of one key."""
    previous, out = None, []
    for arrival, ms in sorted(rows):
        if previous is not None:
            delta = ms - previous[1]
            seconds = abs(delta) // 1000 * (1 if delta >= 0 else -1)
            if seconds > threshold_seconds:
                out.append((previous[0], arrival))
        previous = (arrival, ms)
    return out


def order_flow(rows, window, as_of):
    """rows: (ms, seq, type) of one order; returns (kind, seqs of the evidence)."""
    out = []
    seen = False
    pending, shipped = None, False
    for ms, seq, kind in sorted(rows):
        if kind == "order":
            seen = True
            pending, shipped = seq, False
        elif kind == "shipment":
            if not seen:
                out.append(("shipment_without_order", (seq,)))
            seen = True
            shipped = True
        elif kind == "invoice":
            if pending is not None and not shipped:
                out.append(("invoice_without_shipment", (pending, seq)))
            pending, shipped = None, False
    waiting = None
    for ms, seq, kind in sorted(rows):
        if kind not in ("order", "shipment"):
            continue
        if waiting and ms > waiting[0] + window:
            out.append(("order_unfulfilled", (waiting[1],)))
        waiting = (ms, seq) if kind == "order" else None
    if waiting and as_of > waiting[0] + window:
        out.append(("order_unfulfilled", (waiting[1],)))
    return sorted(out)
