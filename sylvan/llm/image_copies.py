"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales, each gets the direction of its patch's centroid and 128 binary brightness tests turned
into that direction. Quarters of descriptors, taken for two neighbouring corners together, are the keys of a Hamming join: copies
share a key where the same quarter of a corner and of its neighbour is untouched, and they have many corners. A neighbour that
mirrors its corner says nothing more than the corner alone and is passed over. Where keys meet, the whole descriptors must be
close and the neighbour must stand in the same direction and distance, as a corner's own direction and scale have it. Candidate pairs are verified by mutual nearest descriptors that agree on one similarity transform.
Images are grey or colour netpbm files (P5, P6) of any size; others count as unreadable.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import U64, batches, bloom_has, bloom_of, components, lean, lean_group, mix, stored, task_count
from sylvan.llm.ngram_join import _HELD, _by_bucket

_SCALES = (1.0, 2.0)
_MARGIN, _RADIUS, _TURNS_OF = 12, 7, 32
_HEADER = re.compile(rb"\A(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
_CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", 16)])
_ENTRY = np.dtype([("sig", "<u8"), ("id", "<i8"), ("d0", "<u8"), ("d1", "<u8"), ("n0", "<u8"), ("n1", "<u8"), ("to", "u1"), ("turn", "u1"), ("far", "u1")])
_TURNS = 5
#: How far directions (in 256ths of a circle) and distances (in 16ths of a doubling) of neighbours may be apart.
_TURNED, _FARTHER = 20, 6
#: Neighbours of a corner that keys are made with, and how far (in 256ths of a circle) directions may be from those of a mirrored pair.
_NEIGHBOURS, _MIRRORED = 3, 4
#: Images that share a key up to which all pairs of them are looked at in place.
SMALL = 16


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels 0 to 1 of a P5 or P6 file of 8 bits a sample; None if it is not one or is cut short."""
    m = _HEADER.match(data or b"")
    if not m:
        return None
    w, h, most, depth = int(m[2]), int(m[3]), int(m[4]), 1 if m[1] == b"P5" else 3
    if not 0 < most < 256 or not w * h or len(data) - m.end() < w * h * depth:
        return None
    px = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth).astype(np.float32) / most
    return px.mean(axis=2)


def encode(grey: np.ndarray) -> bytes:
    """A P5 file of grey levels 0 to 1."""
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + (np.clip(grey, 0, 1) * 255 + 0.5).astype(np.uint8).tobytes()


def _smooth(x: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        p = np.pad(x, [(0, 0), *((2, 2) if a == axis else (0, 0) for a in (1, 2))], mode="edge")
        n = x.shape[axis]
        s = [np.take(p, range(i, i + n), axis=axis) for i in range(5)]
        x = (s[0] + s[4] + 4 * (s[1] + s[3]) + 6 * s[2]) / 16
    return x


def _tests() -> np.ndarray:
    """[turn, test, (x1, y1, x2, y2)]: places that are compared, for each direction."""
    rng = np.random.default_rng(20)
    p = np.clip(rng.normal(0, _RADIUS / 2, (128, 2, 2)), -_RADIUS, _RADIUS)
    a = np.arange(_TURNS_OF) * 2 * np.pi / _TURNS_OF
    turn = np.stack([np.stack([np.cos(a), -np.sin(a)], 1), np.stack([np.sin(a), np.cos(a)], 1)], 1)
    return np.rint(np.einsum("tij,kpj->tkpi", turn, p)).astype(np.int64).reshape(_TURNS_OF, 128, 4)


_TESTS = _tests()
_DISC = np.argwhere(np.hypot(*np.mgrid[-_RADIUS : _RADIUS + 1, -_RADIUS : _RADIUS + 1]) <= _RADIUS) - _RADIUS


def corners(images: np.ndarray) -> list[np.ndarray]:
    """Corners of each of a stack of images of one size: place in the full image, scale, angle, descriptor."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    for scale in _SCALES:
        x = images
        if scale != 1:
            k = int(scale)
            h, w = images.shape[1] // k * k, images.shape[2] // k * k
            x = images[:, :h, :w].reshape(len(images), h // k, k, w // k, k).mean(axis=(2, 4))
        if min(x.shape[1:]) <= 2 * _MARGIN + 2:
            continue
        s = _smooth(x)
        gy, gx = np.gradient(s, axis=(1, 2))
        a, b, c = _smooth(gx * gx), _smooth(gx * gy), _smooth(gy * gy)
        r = a * c - b * b - 0.05 * (a + c) ** 2
        m = _MARGIN
        core = r[:, m:-m, m:-m]
        peak = core > np.maximum(0.01 * r.max(axis=(1, 2), keepdims=True), 1e-9)
        for dy in range(-3, 4):
            for dx in range(-3, 4):
                if dy or dx:
                    other = r[:, m + dy : r.shape[1] - m + dy, m + dx : r.shape[2] - m + dx]
                    peak &= (core > other) if (dy, dx) > (0, 0) else (core >= other)
        i, yy, xx = np.nonzero(peak)
        yy, xx = yy + m, xx + m
        if not len(i):
            continue
        patch = s[i[:, None], yy[:, None] + _DISC[:, 0], xx[:, None] + _DISC[:, 1]]
        angle = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
        t = _TESTS[np.rint(angle / (2 * np.pi) * _TURNS_OF).astype(np.int64) % _TURNS_OF]
        bits = s[i[:, None], yy[:, None] + t[:, :, 1], xx[:, None] + t[:, :, 0]] < s[i[:, None], yy[:, None] + t[:, :, 3], xx[:, None] + t[:, :, 2]]
        out = np.zeros(len(i), _CORNER)
        out["x"], out["y"], out["scale"], out["angle"], out["bits"] = (xx + 0.5) * scale, (yy + 0.5) * scale, scale, angle, np.packbits(bits, axis=1)
        for n, part in enumerate(np.split(out, np.searchsorted(i, np.arange(1, len(images))))):
            found[n].append(part)
    return [np.concatenate(f) if f else np.zeros(0, _CORNER) for f in found]


def image_corners(data: list) -> list[np.ndarray]:
    """Corners of each encoded image; none where it cannot be read."""
    out = [np.zeros(0, _CORNER)] * len(data)
    shapes: dict[tuple, list[int]] = {}
    grey = [decode(d) for d in data]
    for i, g in enumerate(grey):
        if g is not None:
            shapes.setdefault(g.shape, []).append(i)
    for shape, at in shapes.items():
        step = max(1, 1_000_000 // (shape[0] * shape[1]))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            for i, c in zip(part, corners(np.stack([grey[i] for i in part])), strict=True):
                out[i] = c
    return out


def _neighbours(p: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """For each corner of a scale, those that keys are made with: the nearest that do not mirror it, then those that do, last itself.

    Directions are mirrored across a line between two corners if their sum is half a circle more than twice the direction from
    one corner to the other. ``most`` pairs of corners are looked at in one go.
    """
    out, step = [], 1 + most // len(p)
    for lo in range(0, len(p), step):
        r = np.arange(lo, min(len(p), lo + step))
        x, y = (p[c] - p[c][r, None] for c in ("x", "y"))
        d = x**2 + y**2
        mirrored = np.abs((p["angle"] + p["angle"][r, None] - 2 * np.arctan2(y, x)) / (2 * np.pi) * 256 % 256 - 128) <= _MIRRORED
        d[r - lo, r], mirrored[r - lo, r] = np.inf, True
        out.append(np.lexsort((d, mirrored), axis=1)[:, :_NEIGHBOURS])
    return np.concatenate(out)


def keys(c: np.ndarray, image: int) -> np.ndarray:
    """Entries of the join for an image: each quarter of a descriptor with the same quarter of a neighbour, and both whole.

    Neighbours are the nearest corners of the same scale, which a crop or an edit elsewhere leaves in place; one patch alone,
    often flat or repetitive, would bring unrelated images together. So would a patch and its mirror image, which a border or a
    symmetric shape puts beside it: corners that may be one, by their directions, come after all others. A scale of few corners
    takes these too, and last the corner itself. Two corners have one entry a quarter, whichever is near the other.
    """
    out = [np.zeros(0, _ENTRY)]
    circle = lambda r: np.rint(r / (2 * np.pi) * 256).astype(np.int64) % 256
    for scale in np.unique(c["scale"]).tolist():
        p = c[c["scale"] == scale]
        if len(p) < 2:
            continue
        bits = np.ascontiguousarray(p["bits"])
        q, whole = mix(bits.view("<u4").reshape(-1, 4).astype(U64) * U64(4) + np.arange(4, dtype=U64)), bits.view("<u8").reshape(-1, 2)
        near = _neighbours(p)
        i, j = np.repeat(np.arange(len(p)), near.shape[1]), near.ravel()
        i, j = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        # the lesser quarter comes first, in every image
        lesser = (whole[i, 0] < whole[j, 0]) | (whole[i, 0] == whole[j, 0]) & (whole[i, 1] <= whole[j, 1])
        keep = (q[i] < q[j]) | (q[i] == q[j]) & lesser[:, None]
        i, j = np.where(keep, i[:, None], j[:, None]), np.where(keep, j[:, None], i[:, None])
        e, quarter = np.zeros(i.shape, _ENTRY), np.arange(4)
        e["sig"], e["id"] = mix(q[i, quarter] * U64(0x9E3779B97F4A7C15) + mix(q[j, quarter])), image
        for k in (0, 1):
            e[f"d{k}"], e[f"n{k}"] = whole[i, k], whole[j, k]
        x, y, a = (p[c][j] - p[c][i] for c in ("x", "y", "angle"))
        e["to"], e["turn"] = circle(np.arctan2(y, x) - p["angle"][i]), circle(a)
        e["far"] = np.clip(np.rint(16 * np.log2(np.maximum(np.hypot(x, y) / scale, 1))), 0, 255)
        out.append(e.ravel())
    e = np.concatenate(out)
    return e[np.unique(e["sig"], return_index=True)[1]]


def alike(p: np.ndarray, q: np.ndarray, distance: int = 20) -> np.ndarray:
    """Which pairs of entries have both descriptors within a Hamming distance, and the neighbour in the same place as seen from either."""
    apart = lambda c: np.bitwise_count(p[f"{c}0"] ^ q[f"{c}0"]) + np.bitwise_count(p[f"{c}1"] ^ q[f"{c}1"])
    off = lambda a: np.abs(a.view(np.int8).astype(np.int64))
    to, turn = p["to"] - q["to"], p["turn"] - q["turn"]
    placed = (np.minimum(off(to), off(to - turn)) <= _TURNED) & (off(turn) <= _TURNED) & (np.abs(p["far"].astype(np.int64) - q["far"]) <= _FARTHER)
    return (p["id"] != q["id"]) & (apart("d") <= distance) & (apart("n") <= distance) & placed


def agreeing(a: np.ndarray, b: np.ndarray, distance: int = 20, slack: float = 3.0) -> int:
    """Most mutual nearest descriptors of two images that agree on a similarity transform of the plane."""
    if not len(a) or not len(b):
        return 0
    d = np.bitwise_count(np.ascontiguousarray(a["bits"]).view("<u8").reshape(-1, 1, 2) ^ np.ascontiguousarray(b["bits"]).view("<u8").reshape(1, -1, 2)).sum(axis=2)
    to, back = d.argmin(axis=1), d.argmin(axis=0)
    i = np.flatnonzero((back[to] == np.arange(len(a))) & (d[np.arange(len(a)), to] <= distance))
    if not len(i):
        return 0
    p, q = a[i], b[to[i]]
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    f = (q["scale"] / p["scale"]) * np.exp(1j * np.rint((q["angle"] - p["angle"]) / (np.pi / 16)) * np.pi / 16)
    best = 0
    for k in range(len(i)):  # each match proposes the transform that its two corners define; the others refine it by their own places
        near = np.abs(w - (w[k] + f[k] * (z - z[k]))) <= slack + 0.1 * np.abs(z - z[k])
        if near.sum() > max(2, best):
            u, v = z[near] - z[near].mean(), w[near] - w[near].mean()
            g = (np.conj(u) @ v) / max((np.abs(u) ** 2).sum(), 1e-9)
            best = max(best, int((np.abs(w - w[near].mean() - g * (z - z[near].mean())) <= slack).sum()))
    return best


def linked(pairs: list[tuple[np.ndarray, np.ndarray]], least: int, distance: int = 20, slack: float = 3.0, most: int = 400_000) -> np.ndarray:
    """Whether ``agreeing`` is ``least`` or more, for many pairs of images at once; ``most`` pairs of corners are looked at in one go."""
    out = np.full(len(pairs), least <= 0)
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    # fewer corners than that cannot agree
    some = np.flatnonzero((size.min(axis=1) >= max(1, least)))
    some = some[np.lexsort((size[some, 1], size[some, 0]))]
    lo = 0
    while lo < len(some):
        hi = min(len(some), lo + max(1, most // int(size[some[lo]].prod())))
        while hi - lo > 1 and (hi - lo) * int(size[some[lo:hi]].max(axis=0).prod()) > most:
            hi = lo + (hi - lo) // 2
        out[some[lo:hi]] = _linked([pairs[i] for i in some[lo:hi]], size[some[lo:hi]], least, distance, slack)
        lo = hi
    return out


def _linked(pairs: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, least: int, distance: int, slack: float) -> np.ndarray:
    sides = []
    for k in (0, 1):
        have = np.arange(int(size[:, k].max())) < size[:, k, None]
        c = np.zeros((*have.shape, _CORNER.itemsize // 8), U64)
        c[have] = np.frombuffer(b"".join([p[k].tobytes() for p in pairs]), U64).reshape(-1, c.shape[2])
        sides.append((c.view(_CORNER)[:, :, 0], have))
    (a, in_a), (b, in_b) = sides
    u, v = (np.ascontiguousarray(c["bits"]).view("<u8") for c in (a, b))
    d = np.bitwise_count(u[:, :, None, 0] ^ v[:, None, :, 0]) + np.bitwise_count(u[:, :, None, 1] ^ v[:, None, :, 1])
    d[~in_a] = 255
    d[np.broadcast_to(~in_b[:, None, :], d.shape)] = 255
    to, back = d.argmin(axis=2), d.argmin(axis=1)
    match = in_a & (np.take_along_axis(back, to, axis=1) == np.arange(a.shape[1])) & (np.take_along_axis(d, to[:, :, None], axis=2)[:, :, 0] <= distance)
    n = match.sum(axis=1)
    out = np.zeros(len(pairs), bool)
    rows = np.flatnonzero(n >= least)
    if not len(rows):
        return out
    # the matches of each pair side by side, in the order of corners
    order = np.argsort(~match[rows], axis=1, kind="stable")[:, : int(n.max())]
    there = np.arange(order.shape[1]) < n[rows, None]
    p = np.take_along_axis(a[rows], order, axis=1)
    q = np.take_along_axis(b[rows], np.take_along_axis(to[rows], order, axis=1), axis=1)
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    f = np.where(there, q["scale"], 1) / np.where(there, p["scale"], 1) * np.exp(1j * np.rint((q["angle"] - p["angle"]) / (np.pi / 16)) * np.pi / 16)
    best = np.zeros(len(rows), np.int64)
    for k in range(order.shape[1]):  # as in ``agreeing``, until enough agree
        on = np.flatnonzero(there[:, k] & (best < least))
        if not len(on):
            break
        from_k, to_k = z[on] - z[on, k, None], w[on] - w[on, k, None]
        near = there[on] & (np.abs(to_k - f[on, k, None] * from_k) <= slack + 0.1 * np.abs(from_k))
        m = near.sum(axis=1)
        go = m > np.maximum(2, best[on])
        on, near, m = on[go], near[go], m[go, None]
        x, y = (c[on] - np.where(near, c[on], 0).sum(axis=1, keepdims=True) / m for c in (z, w))
        r = np.where(near, x, 0)
        g = (np.conj(r) * y).sum(axis=1) / np.maximum((np.abs(r) ** 2).sum(axis=1), 1e-9)
        best[on] = np.maximum(best[on], (there[on] & (np.abs(y - g[:, None] * x) <= slack)).sum(axis=1))
    out[rows] = best >= least
    return out


def image_copies(images: DataFrame, least: int = 8, seed: int = 0) -> DataFrame:
    """(id, n_corners, component_id) for each row of ``images`` (id long, image binary).

    Images link when at least ``least`` corners agree; component_id is the least id reached. Images of equal bytes are one
    class and linked. An image that is null, unreadable or without corners links only with equal bytes (null: with nothing).
    A null id stays null and links with nothing. Other columns are ignored.
    """
    images = images.select(F.col("id").cast("long").alias("id"), F.col("image").cast("binary").alias("image"))
    digest = F.unhex(F.sha2("image", 256))

    def describe(rows):
        for ids, data in batches(rows, "id", "image"):
            for lo in range(0, len(ids), 200):
                c = image_corners(data[lo : lo + 200])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[lo : lo + 200], pa.int64()), "n_corners": pa.array(map(len, c), pa.int64()), "corners": pa.array([x.tobytes() for x in c], pa.binary())})

    info = stored(images.select("id", digest.alias("digest")), "images")
    classes = info.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    classes = stored(classes, "image-classes")
    unique = images.withColumn("digest", digest).join(classes, "digest").where("id = rep").dropDuplicates(["id"]).select("id", "image")
    held = stored(unique.mapInArrow(lean(describe), "id long, n_corners long, corners binary"), "image-corners")
    n_buckets = min(1 << 15, 8 * task_count(held))

    def index(rows):
        out, n = [], 0

        def flush():
            e = np.concatenate(out)
            out.clear()
            order, cut = _by_bucket((e["sig"] % U64(n_buckets)).astype(np.int64), n_buckets)
            e = e[order]
            full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "rows": pa.array([e[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())})

        for ids, blobs in batches(rows, "id", "corners"):
            for i, blob in zip(ids, blobs, strict=True):
                out.append(keys(np.frombuffer(blob, _CORNER), i))
                n += len(out[-1])
                if n >= _HELD // 4:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def shared_only(t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("rows").to_pylist()), _ENTRY)
        e = e[np.argsort(e["sig"], kind="stable")]
        start = np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1]]) if len(e) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(e)])
        pairs = [np.zeros((0, 2), np.int64)]
        for g in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            i, j = np.triu_indices(g, 1)
            at = start[size == g]
            for lo in range(0, len(at), 1 + 200_000 // len(i)):
                some = at[lo : lo + 1 + 200_000 // len(i), None]
                p, q = e[(some + i).ravel()], e[(some + j).ravel()]
                ok = alike(p, q)
                pairs.append(np.stack([np.minimum(p["id"][ok], q["id"][ok]), np.maximum(p["id"][ok], q["id"][ok])], axis=1))
        two = np.unique(np.concatenate(pairs), axis=0)
        e = e[np.repeat(size > SMALL, size)] if len(e) else e
        columns = {"id": pa.array(np.r_[two[:, 0], e["id"]])}
        columns["other"] = pa.array(np.r_[two[:, 1], np.zeros(len(e), np.int64)], mask=np.r_[np.zeros(len(two), bool), np.ones(len(e), bool)])
        for c in ("sig", "d0", "d1", "n0", "n1"):
            columns[c] = pa.array(np.r_[np.zeros(len(two), np.int64), e[c].astype(np.int64)])
        for c in ("to", "turn", "far"):
            columns[c] = pa.array(np.r_[np.zeros(len(two), np.int32), e[c].astype(np.int32)])
        return pa.table(columns)

    entries = held.select("id", "corners").mapInArrow(lean(index), "bucket int, rows binary").groupBy("bucket")
    entries = stored(entries.applyInArrow(lean_group(shared_only), "id long, other long, sig long, d0 long, d1 long, n0 long, n1 long, to int, turn int, far int"), "image-keys")
    few = entries.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    apart = lambda p, q, c: F.bit_count(F.col(f"{p}.{c}0").bitwiseXOR(F.col(f"{q}.{c}0"))) + F.bit_count(F.col(f"{p}.{c}1").bitwiseXOR(F.col(f"{q}.{c}1")))
    less = lambda p, q, c: F.col(f"{p}.{c}") - F.col(f"{q}.{c}")
    off = lambda a: F.least(F.pmod(a, F.lit(256)), F.pmod(-a, F.lit(256)))
    placed = lambda p, q: (F.least(off(less(p, q, "to")), off(less(p, q, "to") - less(p, q, "turn"))) <= _TURNED) & (off(less(p, q, "turn")) <= _TURNED)
    close = lambda p, q: (apart(p, q, "d") <= 20) & (apart(p, q, "n") <= 20) & placed(p, q) & (F.abs(F.col(f"{p}.far") - F.col(f"{q}.far")) <= _FARTHER)

    def verified(pairs: DataFrame) -> DataFrame:
        def verify(rows):
            for a, b, p, q in batches(rows, "a", "b", "p", "q"):
                ok = linked([(np.frombuffer(x, _CORNER), np.frombuffer(y, _CORNER)) for x, y in zip(p, q, strict=True)], least)
                yield pa.RecordBatch.from_pydict({c: pa.array([v for v, o in zip(values, ok, strict=True) if o], pa.int64()) for c, values in (("a", a), ("b", b))})

        have = held.select("id", "corners")
        one = pairs.join(have.select(F.col("id").alias("b"), F.col("corners").alias("q")), "b")
        return one.join(have.select(F.col("id").alias("a"), F.col("corners").alias("p")), "a").select("a", "b", "p", "q").mapInArrow(lean(verify), "a long, b long")

    links, tried, before = None, None, None
    left = entries.where("other is null").drop("other").withColumn("c", F.col("id"))
    for turn in range(_TURNS):
        h = lambda c: F.xxhash64(c, F.lit(seed + turn))  # noqa: B023, E731
        whole = F.struct(h("id").alias("o"), "id", "c", "d0", "d1", "n0", "n1", "to", "turn", "far")
        hubs = left.groupBy("sig").agg(F.min(whole).alias("h"), F.max(whole).alias("k"))
        one = left.alias("x").join(hubs, "sig").select(F.col("x.id").alias("id"), F.when((F.col("h.c") != F.col("x.c")) & close("x", "h"), F.col("h.id")).when((F.col("k.c") != F.col("x.c")) & close("x", "k"), F.col("k.id")).alias("hub")).where("hub is not null")
        one = one.groupBy("id", "hub").agg(F.count("*").alias("n")).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"), "id", "n")
        one = one if tried is None else one.join(tried, ["a", "b"], "left_anti")
        pairs = stored(one.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("n", F.xxhash64("a", "b"))).alias("p")).select("p.*").distinct(), "image-pairs")
        got = verified(pairs)
        links = stored(got if links is None else links.union(got), "image-links")
        tried = pairs if tried is None else tried.union(pairs)
        reached = components(links).withColumnRenamed("id", "v")
        left = stored(left.drop("c").join(reached, F.col("id") == F.col("v"), "left").select("sig", "id", "d0", "d1", "n0", "n1", "to", "turn", "far", F.coalesce("component", "id").alias("c")), "image-entries")
        sizes = stored(left.groupBy("sig", "c").agg(F.count("*").alias("m")).groupBy("sig").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"), F.count("*").alias("k")).where("k > 1"), "image-sizes")
        left = stored(left.join(sizes.select("sig"), "sig", "left_semi"), "image-left")
        n, open_pairs = sizes.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.lit(0.0))).first()
        if open_pairs <= 2 * n + 1000 or before is not None and open_pairs > 0.8 * before:
            break
        before = open_pairs
    rest = left.alias("x").join(left.alias("y"), F.expr("x.sig = y.sig and x.c <> y.c and x.id < y.id") & close("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    of = lambda c, as_: reached.select(F.col("v").alias(c), F.col("component").alias(as_))
    few = few.join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left").where(F.coalesce("p", "a") != F.coalesce("q", "b"))
    rest = stored(rest.union(few.select("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"), "image-rest")
    if not rest.isEmpty():
        links = links.union(verified(rest))
    reached = components(links).withColumnRenamed("id", "v")
    of = classes.join(reached, F.col("rep") == F.col("v"), "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    of = of.join(held.select(F.col("id").alias("rep"), "n_corners"), "rep", "left").select("digest", "component", "n_corners")
    out = info.join(of, "digest", "left")
    return out.select("id", F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _enlarged(grid: np.ndarray, times: int) -> np.ndarray:
    """The grid drawn ``times`` as large, with linear interpolation."""
    for axis in (0, 1):
        n = grid.shape[axis]
        at = np.clip((np.arange(n * times) + 0.5) / times - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(np.int64), max(0, n - 2))
        part = (at - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        grid = np.take(grid, lo, axis) * (1 - part) + np.take(grid, np.minimum(lo + 1, n - 1), axis) * part
    return grid


def rendered(vectors: DataFrame, block: int = 6) -> DataFrame:
    """(id, image): each vector drawn as a grey P5 image, its values as brightness on a square grid with a
    mirrored border of two.

    The tables hold no media; pictures of vectors give near copies where vectors are near copies. Values are scaled by four
    standard deviations of a unit vector of that length. A null vector, or one that holds nulls or non-finite values, gives a
    null image.
    """

    def draw(rows):
        for ids, vs in batches(rows, "id", "v"):
            out = []
            for v in vs:
                a = np.array(v, float) if v and None not in v else np.array([np.nan])
                norm = np.sqrt((a * a).sum())
                if not np.isfinite(norm) or norm == 0:
                    out.append(None)
                    continue
                w = int(np.ceil(np.sqrt(len(a))))
                grid = np.full(-(-len(a) // w) * w, 0.5)
                grid[: len(a)] = 0.5 + a / norm * np.sqrt(len(a)) / 8
                out.append(encode(_enlarged(np.pad(grid.reshape(-1, w), min(2, w - 1), mode="reflect") if len(grid) >= 4 * w else grid.reshape(-1, w), block)))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "image": pa.array(out, pa.binary())})

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(lean(draw), "id long, image binary")
