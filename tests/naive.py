"""Brute-force twins of the operators, written from their definitions."""
import itertools
import math


def iou2(a, b):
    w = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    h = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return inter / union if union > 0 else 0.0


def place(r):
    return (r["slice_z"], r["x1"], r["y1"], r["x2"], r["y2"], r["det_id"])


def tubes(rows, cfg):
    """{seed det_id: set of member det_ids} of one volume."""
    free = {r["det_id"]: r for r in rows}
    centre = lambda r: ((r["x1"] + r["x2"]) / 2.0, (r["y1"] + r["y2"]) / 2.0)
    out = {}
    for seed in sorted(rows, key=lambda r: (-r["score"], place(r))):
        if seed["det_id"] not in free:
            continue
        del free[seed["det_id"]]
        tube = [seed]
        for sign in (1, -1):
            head = seed
            while True:
                near = [r for r in free.values() if 1 <= sign * (r["slice_z"] - head["slice_z"]) <= cfg.max_z_gap + 1]
                near = [(iou2(head, r), r) for r in sorted(near, key=place)]
                best = max((i for i, _ in near), default=-1.0)
                if best < cfg.link_iou:
                    break
                nxt = next(r for i, r in near if i == best)
                zs = [r["slice_z"] for r in tube] + [nxt["slice_z"]]
                if cfg.max_tube_zspan is not None and max(zs) - min(zs) + 1 > cfg.max_tube_zspan:
                    break
                mx = sum(centre(r)[0] for r in tube) / len(tube)
                my = sum(centre(r)[1] for r in tube) / len(tube)
                cx, cy = centre(nxt)
                if cfg.max_centroid_drift is not None and ((cx - mx) ** 2 + (cy - my) ** 2) ** 0.5 > cfg.max_centroid_drift:
                    break
                del free[nxt["det_id"]]
                tube.append(nxt)
                head = nxt
        if len(tube) >= cfg.min_tube_len:
            out[seed["det_id"]] = {r["det_id"] for r in tube}
    return out


def keep_best(rows, prio, row_id, conflict):
    kept = []
    for r in sorted(rows, key=lambda r: (-prio(r), r[row_id])):
        if not any(conflict(k, r) for k in kept):
            kept.append(r)
    return {r[row_id] for r in kept}


def dist(a, b, cols):
    return math.sqrt(sum((a[c] - b[c]) ** 2 for c in cols))


def components(nodes, linked):
    """{node: smallest node of its component}."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if linked(a, b) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def match_greedily(dets, gts, t):
    """{det_id: is_tp} over slices; every detection takes its best free box in score order."""
    used, out = set(), {}
    for d in sorted(dets, key=lambda r: (-r["score"], r["det_id"])):
        best, pick = 0.0, None
        for g in sorted(gts, key=lambda g: g["component_id"]):
            key = (g["volume_id"], g["slice_z"], g["component_id"])
            if (g["volume_id"], g["slice_z"]) == (d["volume_id"], d["slice_z"]) and key not in used:
                box = {"x1": g["c0"], "y1": g["r0"], "x2": g["c1"] + 1, "y2": g["r1"] + 1}
                i = iou2(d, box)
                if i > best:
                    best, pick = i, key
        hit = pick is not None and best >= t
        if hit:
            used.add(pick)
        out[d["det_id"]] = int(hit)
    return out


def average_precision(dets, tp, n_gt):
    tps = fps = 0
    points = []
    for d in sorted(dets, key=lambda r: (-r["score"], r["det_id"])):
        tps, fps = tps + tp[d["det_id"]], fps + 1 - tp[d["det_id"]]
        points.append((tp[d["det_id"]], tps / (tps + fps)))
    return sum(max(p for _, p in points[i:]) for i, (hit, _) in enumerate(points) if hit) / n_gt
