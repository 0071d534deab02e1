"""Cropped, rotated, scaled and edited copies of images, by local descriptors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.llm.common import partitions, runs, written

#: Side of the tiles that corners are chosen in, corners of a tile at full size and at halvings, angles that orientations are rounded to, bits of a descriptor, radius of the tests and of
#: the orientation.
TILE, CORNERS, ANGLES, BITS, REACH, DISC = 48, (7, 20), 32, 256, 8, 7

#: Nothing that is read lies farther from a corner: the reach, its rounding and the smoothing.
MARGIN = REACH + 3

#: Bits in which matching descriptors may differ, pixels of a cell of the votes, corners that must agree.
DIFFERING, VOTE_CELL, AGREEING = 20, 16, 5

#: Chance that descriptors which differ in ``DIFFERING`` spread bits share a cell of some table, stored
#: corners that a cell should hold, and the most of each side that are compared in one step.
MEETING, CELL, BLOCK = 0.9, 1024, 32_768

#: Nearest corners that vouch for a corner; corners more rows apart than ``AROUND`` are no neighbours. Bits
#: of a neighbour's descriptor that are kept, how many of them may differ, pixels of a step in which
#: its place is kept, and steps by which that may differ.
NEIGHBOURS, AROUND = 4, 2 * TILE
SKETCH, SKETCH_DIFFERING, STEP, STEPS = 15, 3, 2, 1

IMAGE = "image_id long, height int, width int, pixels binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few images at once: their corners and pictures take much more room than the rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 128):
            yield batch.slice(begin, 128)


def _tests() -> np.ndarray:
    """Offsets (angle, bit, point, y x) of the binary tests, turned to each angle. Quarter turns are exact."""
    rng = np.random.default_rng(11)
    points = rng.normal(scale=REACH / 2.2, size=(4 * BITS, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) <= REACH).all(axis=1)][:BITS]
    quarter = ANGLES // 4
    out = np.zeros((ANGLES, BITS, 2, 2), np.int64)
    for a in range(quarter):
        c, s = math.cos(2 * math.pi * a / ANGLES), math.sin(2 * math.pi * a / ANGLES)
        y, x = points[..., 0], points[..., 1]
        out[a] = np.rint(np.stack([s * x + c * y, c * x - s * y], axis=-1))
    for a in range(quarter, ANGLES):
        before = out[a - quarter]
        out[a] = np.stack([before[..., 1], -before[..., 0]], axis=-1)
    return out


_TESTS = _tests()
_AROUND = np.array([(y, x) for y in range(-DISC, DISC + 1) for x in range(-DISC, DISC + 1) if y * y + x * x <= DISC * DISC])


def _box(block: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r + 1 pixels; squares end at the border."""
    for axis in (1, 2):
        n = block.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(block, [0], axis)), np.cumsum(block, axis=axis, dtype=block.dtype)], axis=axis)
        i = np.arange(n)
        block = np.take(sums, np.minimum(i + r + 1, n), axis) - np.take(sums, np.maximum(i - r, 0), axis)
    return block


def _corners(block: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of the ``count`` strongest corners of each tile, by the structure tensor of the gradients."""
    n, h, w = block.shape
    dy, dx = np.zeros(block.shape, np.float64), np.zeros(block.shape, np.float64)
    dy[:, 1:-1] = block[:, 2:] - block[:, :-2]
    dx[:, :, 1:-1] = block[:, :, 2:] - block[:, :, :-2]
    yy, xx, xy = _box(dy * dy, 2), _box(dx * dx, 2), _box(dy * dx, 2)
    score = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    inner = score[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN]
    top = inner > 1e6
    for y in range(-2, 3):
        for x in range(-2, 3):
            if y or x:
                near = score[:, MARGIN + y : h - MARGIN + y, MARGIN + x : w - MARGIN + x]
                top &= inner >= near if (y, x) > (0, 0) else inner > near
    image, y, x = np.nonzero(top)
    across, down = math.ceil(w / TILE), math.ceil(h / TILE)
    tile = (image * down + (y + MARGIN) // TILE) * across + (x + MARGIN) // TILE
    order = np.lexsort((x, y, -inner[image, y, x], tile))
    image, y, x, tile = image[order], y[order], x[order], tile[order]
    rank = np.arange(len(tile)) - np.searchsorted(tile, tile)
    keep = rank < count
    return image[keep], y[keep] + MARGIN, x[keep] + MARGIN


def _neighbours(image: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """What vouches for each corner: the nearest corners of its image, 31 bits each; fewer are filled up with -1.

    From the lowest bit on: the sketch of the neighbour's descriptor, its place across and down in steps
    (6 bits each), and its angle in sixteenths of a turn, the last three relative to the corner's direction.
    """
    out = np.full((len(image), NEIGHBOURS), -1, np.int64)
    order = np.lexsort((x, y, image))
    starts = np.searchsorted(image[order], np.unique(image))
    for own in np.split(order, starts[1:]):
        rows, columns = y[own], x[own]
        for begin in range(0, len(own), 256):
            part = np.arange(begin, min(begin + 256, len(own)))
            low, high = np.searchsorted(rows, [rows[part[0]] - AROUND, rows[part[-1]] + AROUND + 1])
            dy, dx = rows[None, low:high] - rows[part, None], columns[None, low:high] - columns[part, None]
            # Ties go by place, which sorting has fixed.
            far = dy * dy + dx * dx
            far[np.abs(dy) > AROUND] = 1 << 40
            far[part - begin, part - low] = 1 << 41
            nearest = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
            far, dy, dx = (np.take_along_axis(a, nearest, axis=1) for a in (far, dy, dx))
            other, turn = own[low + nearest], angle[own[part], None]
            c, s = np.cos(2 * math.pi * turn / ANGLES), np.sin(2 * math.pi * turn / ANGLES)
            across, down = (
                np.clip(np.rint(v / STEP).astype(np.int64) + 32, 0, 63) for v in (c * dx + s * dy, c * dy - s * dx)
            )
            about = (angle[other] - turn) % ANGLES * 16 // ANGLES
            packed = sketches[other] | across << SKETCH | down << SKETCH + 6 | about << SKETCH + 12
            out[own[part], : nearest.shape[1]] = np.where(far < 1 << 40, packed, -1)
    return out


def describe(block: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For images (n, height, width) of one size, per halving until they are too small: image, level, x, y, angle, descriptor
    and neighbours of each corner."""
    block, out = block.astype(np.int64), []
    level = 0
    while min(block.shape[1:]) > 2 * MARGIN:
        image, y, x = _corners(block, CORNERS[min(level, 1)])
        smooth = _box(block, 2)
        around = smooth[image[:, None], y[:, None] + _AROUND[:, 0], x[:, None] + _AROUND[:, 1]]
        turn = np.arctan2(around @ _AROUND[:, 0], around @ _AROUND[:, 1]) / (2 * math.pi) * ANGLES
        angle = np.rint(turn).astype(np.int64) % ANGLES
        where = _TESTS[angle]
        value = smooth[image[:, None, None], y[:, None, None] + where[..., 0], x[:, None, None] + where[..., 1]]
        bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1).reshape(-1, BITS // 8)
        words = bits.view(np.int64).reshape(-1, BITS // 64)
        near = _neighbours(image, y, x, angle, words[:, 0] & (1 << SKETCH) - 1)
        out.append((image, np.full(len(image), level), x << level, y << level, angle, words, near))
        h, w = (s // 2 * 2 for s in block.shape[1:])
        small = block[:, :h, :w]
        block = (small[:, ::2, ::2] + small[:, 1::2, ::2] + small[:, ::2, 1::2] + small[:, 1::2, 1::2]) // 4
        level += 1
    return out


_CORNER = "array<struct<level:int,x:int,y:int,angle:int,d:array<long>,near:array<long>>>"


def described(images: DataFrame) -> DataFrame:
    """``image_id, h1, h2, corners`` of ``images`` (image_id, height, width, pixels: 8-bit grey, row by row).

    Null images, and those whose pixels do not fill height and width, have no corners.
    """
    kind = pa.list_(pa.struct([(f, pa.int32()) for f in ("level", "x", "y", "angle")] + [(f, pa.list_(pa.int64())) for f in ("d", "near")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            heights, widths, pixels = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found: list[list[dict]] = [[] for _ in pixels]
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, (h, w, p) in enumerate(zip(heights, widths, pixels, strict=True)):
                if p is not None and h and w and h > 0 and len(p) == h * w:
                    sizes.setdefault((h, w), []).append(i)
            for (h, w), rows in sizes.items():
                at_once = max(1, (1 << 20) // (h * w))
                for part in range(0, len(rows), at_once):
                    own = rows[part : part + at_once]
                    block = np.frombuffer(b"".join(pixels[i] for i in own), np.uint8).reshape(-1, h, w)
                    for fields in describe(block):
                        for i, level, x, y, angle, d, near in zip(*(f.tolist() for f in fields), strict=True):
                            found[own[i]].append({"level": level, "x": x, "y": y, "angle": angle, "d": d, "near": near})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), batch.column(5), pa.array(found, kind)], names=["image_id", "h1", "h2", "corners"]
            )

    content = [F.xxhash64("height", "width", "pixels").alias("h1"), F.xxhash64(F.lit(1), "height", "width", "pixels").alias("h2")]
    return images.select("image_id", "height", "width", "pixels", *content).mapInArrow(
        run, f"image_id long, h1 long, h2 long, corners {_CORNER}"
    )


def tables(corners: int) -> np.ndarray:
    """The bits (table, bit) that key each table, for so many stored corners.

    A key has about as many bits as leave ``CELL`` corners in a cell. Descriptors that differ in
    ``DIFFERING`` of their bits agree in such a key with a known chance, and so many tables are made
    that they share a cell in one of them with the chance ``MEETING``.
    """
    bits = max(0, math.ceil(math.log2(max(corners, 1) / CELL)))
    same = math.comb(BITS - DIFFERING, bits) / math.comb(BITS, bits)
    count = 1 if same == 1 else math.ceil(math.log(1 - MEETING) / math.log(1 - same))
    rng = np.random.default_rng(17)
    return np.array([rng.permutation(BITS)[:bits] for _ in range(count)], np.int64)


def cell_keys(descriptors: np.ndarray, keyed: np.ndarray) -> np.ndarray:
    """The cell of each descriptor (row of 64-bit words) in each table."""
    bits = np.unpackbits(np.ascontiguousarray(descriptors).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits[:, keyed].astype(np.int64) @ (1 << np.arange(keyed.shape[1], dtype=np.int64))


def near_descriptors(asked: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``asked`` and ``stored`` (64-bit words) that differ in at most ``DIFFERING`` bits."""
    # Bits of signed numbers would be those of their absolute values.
    asked, stored = asked.view(np.uint64), stored.view(np.uint64)
    found_q, found_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # The first half of the words at once, each in a row of its own; the others only where these are near.
    first = np.ascontiguousarray(stored.T[: BITS // 128])
    for begin in range(0, len(asked), 16):
        some = asked[begin : begin + 16]
        differing = np.zeros((len(some), len(stored)), np.uint8)
        for word, ours in enumerate(first):
            differing += np.bitwise_count(some[:, word, None] ^ ours[None])
        q, i = np.divmod(np.flatnonzero(differing <= DIFFERING), len(stored))
        near = np.bitwise_count(some[q] ^ stored[i]).sum(axis=1) <= DIFFERING
        found_q.append(q[near] + begin)
        found_i.append(i[near])
    return np.concatenate(found_q), np.concatenate(found_i)


def vouched(asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Whether some neighbour on the one side looks and lies like one on the other, for rows of neighbours."""
    out = np.zeros(len(asked), bool)
    for k in range(NEIGHBOURS):
        ours = asked[:, k, None]
        near = (ours >= 0) & (stored >= 0)
        differing = np.bitwise_count(((ours ^ stored) & (1 << SKETCH) - 1).view(np.uint32))
        near &= differing <= SKETCH_DIFFERING
        for shift in (SKETCH, SKETCH + 6):
            near &= np.abs((ours >> shift & 63) - (stored >> shift & 63)) <= STEPS
        turn = ((ours >> SKETCH + 12) - (stored >> SKETCH + 12)) & 15
        out |= (near & ((turn <= 1) | (turn == 15))).any(axis=1)
    return out


_FIELDS = ("level", "x", "y", "angle")
_POSTING = "table int, cell long, id long, n int, level int, x int, y int, angle int, d binary"
_CELL_KEYS = ["table", "cell", "q_block", "i_block"]


def _postings(described_images: DataFrame, keyed: np.ndarray) -> DataFrame:
    """A row for each corner and table, with the cell of its descriptor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            ids = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
            n = pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32))
            words = flat.field("d").flatten().to_numpy().reshape(-1, BITS // 64)
            cells = cell_keys(words, keyed)
            sketches = flat.field("near").flatten().to_numpy().astype(np.int32)
            # The descriptor and its neighbours, as 32-bit numbers; -1 is none.
            both = np.concatenate([words.view(np.uint8), sketches.view(np.uint8).reshape(len(words), -1)], axis=1)
            packed = pa.array([row.tobytes() for row in both], pa.binary())
            for table in range(len(keyed)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), table, np.int32)), pa.array(cells[:, table]), ids, n,
                     *[flat.field(f) for f in _FIELDS], packed],
                    names=["table", "cell", "id", "n", *_FIELDS, "d"],
                )

    return described_images.select("image_id", "corners").mapInArrow(run, _POSTING)


def _met(asked: DataFrame, stored: DataFrame, keyed: np.ndarray) -> DataFrame:
    """The corners of both sides (q_, i_) that share a cell and differ in at most ``DIFFERING`` bits.

    Cells of more than ``BLOCK`` corners of a side are dealt into blocks, and each block of the one side
    meets each of the other in a task of its own. Corners that share cells of several tables meet in each.
    """
    cell = ["table", "cell"]
    q, i = _postings(asked, keyed), _postings(stored, keyed)
    sizes = written(
        q.groupBy(*cell).agg(F.count("*").alias("q_rows")).join(i.groupBy(*cell).agg(F.count("*").alias("i_rows")), cell)
        .select(*cell, *[F.ceil(F.col(f"{s}_rows") / BLOCK).cast("int").alias(f"{s}_blocks") for s in "qi"]),
        "corner-cells",
    )

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "n"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return side.join(sizes, cell).select(*cell, mine, each, F.lit(own == "q").alias("asks"), "id", "n", *_FIELDS, "d")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _CELL_KEYS):
            asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            packed = np.frombuffer(b"".join(group.column("d").to_pylist()), np.uint8).reshape(len(asks), -1)
            words = np.ascontiguousarray(packed[:, : BITS // 8]).view(np.int64)
            sketches = np.ascontiguousarray(packed[:, BITS // 8 :]).view(np.int32)
            rows = np.flatnonzero(asks), np.flatnonzero(~asks)
            near = near_descriptors(words[rows[0]], words[rows[1]])
            sure = vouched(sketches[rows[0][near[0]]], sketches[rows[1][near[1]]])
            near = near[0][sure], near[1][sure]
            if len(near[0]):
                sides = [group.select(["id", "n", *_FIELDS]).take(pa.array(r[m])) for r, m in zip(rows, near, strict=True)]
                columns = [c.combine_chunks() for side in sides for c in side.columns]
                yield from pa.Table.from_arrays(columns, names=[f"{s}_{f}" for s in "qi" for f in ("id", "n", *_FIELDS)]).to_batches()

    both = dealt(q, "q", "i").unionByName(dealt(i, "i", "q"))
    n = partitions(asked.sparkSession)
    schema = ", ".join(f"{s}_id long, " + ", ".join(f"{s}_{f} int" for f in ("n", *_FIELDS)) for s in "qi")
    return both.repartition(n, *_CELL_KEYS).sortWithinPartitions(*_CELL_KEYS).mapInArrow(compare, schema)


def _cell(value: Column, grid: Column) -> Column:
    return F.floor((value + grid * VOTE_CELL / 2) / VOTE_CELL)


def find_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """``query_id, image_id, inliers, copies``: the images that a query image is a copy or an edited part of.

    Both tables hold ``image_id, height, width, pixels``. Corners are found at every halving, turned to the
    direction of their surroundings and described by ``BITS`` comparisons of smoothed pixels, which cropping,
    quarter turns, brightness and contrast leave alone. Descriptors that share a cell of one of the ``tables``
    are compared, and match if they differ in at most ``DIFFERING`` bits; those that differ in just so many
    meet with the chance ``MEETING``, nearer ones with a better one. A match says how the query would lie on
    the image: turn, scale and shift. At least ``AGREEING`` corners must say the same, up to ``VOTE_CELL``
    pixels and an eighth of a turn.

    Images of equal pixels are one, under their smallest id; ``copies`` counts them. Images without texture
    have no corners and find nothing. Null images find nothing; null ids of images are no answers. Queries
    of equal ids are one query. Empty tables give an empty result. Extra columns are ignored.
    """
    stored = written(
        described(images.where("image_id IS NOT NULL")).groupBy("h1", "h2").agg(
            F.min("image_id").alias("image_id"), F.count("*").alias("copies"), F.any_value("corners").alias("corners")),
        "image-corners",
    )
    asked = written(described(queries.where("image_id IS NOT NULL")), "query-corners")
    corners = stored.agg(F.sum(F.size("corners"))).first()[0] or 0
    met = _met(asked, stored, tables(corners))
    corner = ["q_id", "i_id", "q_n", "i_n"]
    turn = F.pmod(F.col("i_angle") - F.col("q_angle"), F.lit(ANGLES))
    scale = F.col("i_level") - F.col("q_level")
    radians, factor = turn * (2 * math.pi / ANGLES), F.pow(F.lit(2.0), scale)
    shift_x = F.col("i_x") - factor * (F.cos(radians) * F.col("q_x") - F.sin(radians) * F.col("q_y"))
    shift_y = F.col("i_y") - factor * (F.sin(radians) * F.col("q_x") + F.cos(radians) * F.col("q_y"))
    votes = met.select(
        *corner, F.pmod(F.floor((turn + 2) / 4), F.lit(ANGLES // 4)).alias("turn"), scale.alias("scale"),
        shift_x.alias("sx"), shift_y.alias("sy"), F.explode(F.array(F.lit(0), F.lit(1))).alias("grid"),
    ).select("q_id", "i_id", "q_n", "turn", "scale", "grid", _cell(F.col("sx"), F.col("grid")).alias("cx"), _cell(F.col("sy"), F.col("grid")).alias("cy"))
    place = ["q_id", "i_id", "turn", "scale", "grid", "cx", "cy"]
    # At most the corners of one query image.
    agreed = votes.groupBy(*place).agg(F.size(F.collect_set("q_n")).alias("inliers")).where(F.col("inliers") >= AGREEING)
    best = written(agreed.groupBy("q_id", "i_id").agg(F.max("inliers").alias("inliers")), "image-votes")
    return best.join(stored.select(F.col("image_id").alias("i_id"), "copies"), "i_id").select(
        F.col("q_id").alias("query_id"), F.col("i_id").alias("image_id"), "inliers", "copies"
    )


#: Side of the pictures that ``rendered`` draws; sides and shades of their tiles, which add up.
SIDE, TILES = 96, ((4, 150), (8, 50), (16, 40))


def rendered(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """A picture for each vector: grey tiles of several sizes, drawn by a hash of the vector. Equal vectors give equal pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            pixels = []
            for seed in batch.column(1).to_pylist():
                rng = np.random.default_rng(seed & (2**64 - 1))
                picture = np.zeros((SIDE, SIDE), np.int64)
                for tile, shades in TILES:
                    picture += np.kron(rng.integers(0, shades, (SIDE // tile, SIDE // tile)), np.ones((tile, tile), np.int64))
                pixels.append(picture.astype(np.uint8).tobytes())
            sides = pa.array(np.full(len(pixels), SIDE), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sides, sides, pa.array(pixels, pa.binary())],
                                             names=["image_id", "height", "width", "pixels"])

    return vectors.select(F.col(key).cast("long"), F.xxhash64(value)).mapInArrow(run, IMAGE)


#: Edits that ``edited`` makes, and harder ones that change descriptors.
EDITS = ("crop", "crop and contrast", "crop and quarter turn", "half size")
HARDER = ("scale 0.7", "scale 0.35", "turn", "noise", "16 levels", "crop of a half")


def _sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``image`` between its pixels, linear in both directions."""
    y, x = np.clip(y, 0, image.shape[0] - 1.001), np.clip(x, 0, image.shape[1] - 1.001)
    top, left = y.astype(int), x.astype(int)
    v, u = y - top, x - left
    upper = image[top, left] * (1 - u) + image[top, left + 1] * u
    lower = image[top + 1, left] * (1 - u) + image[top + 1, left + 1] * u
    return np.rint(upper * (1 - v) + lower * v).astype(np.int64)


def _harder(image: np.ndarray, kind: str, rng: np.random.Generator) -> np.ndarray:
    h, w = image.shape
    if kind.startswith("scale"):
        factor = float(kind.split()[1])
        y, x = ((np.arange(round(n * factor)) + 0.5) / factor - 0.5 for n in (h, w))
        return _sampled(image, *np.meshgrid(y, x, indexing="ij"))
    if kind == "turn":
        # By 10 to 30 degrees; the middle, which has no empty corners.
        angle, side = math.radians(rng.uniform(10, 30)), int(min(h, w) * 0.7)
        y, x = np.meshgrid(*[np.arange(side) - (side - 1) / 2] * 2, indexing="ij")
        c, s = math.cos(angle), math.sin(angle)
        return _sampled(image, s * x + c * y + (h - 1) / 2, c * x - s * y + (w - 1) / 2)
    if kind == "noise":
        return np.clip(np.rint(image + rng.normal(scale=8, size=(h, w))), 0, 255).astype(np.int64)
    if kind == "16 levels":
        return image // 16 * 16 + 8
    top, left = (int(x) for x in rng.integers(0, [h - h // 2 + 1, w - w // 2 + 1]))
    return image[top : top + h // 2, left : left + w // 2]


def edited(images: DataFrame, edits: tuple[str, ...] = EDITS) -> DataFrame:
    """An edited copy of each image, and the ``edit``: one of ``edits``, drawn from the id like the place of the crop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for key, h, w, pixels in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rng = np.random.default_rng(key)
                edit = edits[int(rng.integers(len(edits)))]
                kind = EDITS.index(edit) if edit in EDITS else None
                image = np.frombuffer(pixels, np.uint8).reshape(h, w).astype(np.int64)
                if kind is None:
                    image = _harder(image, edit, rng)
                elif kind < 3:
                    top, left = (int(x) for x in rng.integers(0, [h // 4 + 1, w // 4 + 1]))
                    image = image[top : top + h - h // 4, left : left + w - w // 4]
                else:
                    image = (image[::2, ::2] + image[1::2, ::2] + image[::2, 1::2] + image[1::2, 1::2]) // 4
                if kind == 1:
                    image = np.clip(image * 4 // 5 + 30, 0, 255)
                if kind == 2:
                    image = np.rot90(image, int(rng.integers(1, 4)))
                rows.append((key, *image.shape, image.astype(np.uint8).tobytes(), edit))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["image_id", "height", "width", "pixels", "edit"])

    return images.where("image_id IS NOT NULL AND pixels IS NOT NULL").select(
        "image_id", "height", "width", "pixels").mapInArrow(run, f"{IMAGE}, edit string")
