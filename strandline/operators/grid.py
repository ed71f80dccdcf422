"""Detectors over windows of small integer grids (window_id, frame_id, grid: cells 0 to 9 in row order; t_us where rates are asked).

Cells of a frame stay one array: lag() brings the last frame's array and array functions compare the two, so a window costs one shuffle
by window and no row per cell. A detector is what it measures of a frame, how frames add up to a window, and when the window fires;
so one, several or all of them run over the same frames with one shuffle. Grids may have any height and width, given by a Shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Region = Callable[[int, int], bool]


def everywhere(y: int, x: int) -> bool:
    return True


@dataclass(frozen=True)
class Shape:
    """Height and width of the grids. A region's cells are looked up by their numbers, which are constants of the plan."""

    h: int = 8
    w: int = 8

    def numbers(self, region: Region) -> list[int]:
        return [y * self.w + x for y in range(self.h) for x in range(self.w) if region(y, x)]

    def size(self, region: Region) -> int:
        return len(self.numbers(region))

    def cells(self, grid: Column, region: Region) -> Column:
        numbers = self.numbers(region)
        if len(numbers) == self.h * self.w:
            return grid
        return F.transform(F.lit(numbers), lambda k: F.get(grid, k)) if numbers else F.slice(grid, 1, 0)

    def count(self, grid: Column, region: Region, test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(self.cells(grid, region), test))

    def share(self, grid: Column, region: Region, low: int, high: int) -> Column:
        """Part of the region's cells from low to high; 0 of an empty region."""
        n = self.size(region)
        return self.count(grid, region, lambda v: v.between(low, high)) / n if n else F.lit(0.0)

    def moves(self, grid: Column, last: Column, region: Region, least: int) -> Column:
        """How many of the region's cells changed by `least` or more; null for a first frame."""
        moved = F.zip_with(self.cells(grid, region), self.cells(last, region), lambda a, b: F.abs(a - b) >= least)
        return F.when(last.isNotNull(), F.size(F.filter(moved, lambda v: v)))

    def changed(self, grid: Column, last: Column, region: Region, least: int) -> Column:
        """Part of the region's cells that changed by `least` or more; null for a first frame."""
        n, moves = self.size(region), self.moves(grid, last, region, least)
        return moves / n if n else moves * 0.0

    def centroid(self, grid: Column, region: Region, empty: tuple[int, int]) -> tuple[Column, Column]:
        """(y, x) of the region, weighted by value; `empty` where it has no weight."""
        numbers, cells = self.numbers(region), self.cells(grid, region)
        add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
        weight = add(cells)
        along = lambda axis: F.zip_with(cells, F.lit(axis), lambda v, k: v * k)
        axes = [k // self.w for k in numbers], [k % self.w for k in numbers]
        return tuple(F.when(weight > 0, add(along(axis)) / weight).otherwise(float(e)) if axis else F.lit(float(e)) for axis, e in zip(axes, empty, strict=True))

    def step(self, grid: Column, last: Column, region: Region, empty: tuple[int, int]) -> Column:
        """How far the centroid moved; null for a first frame."""
        (y, x), (b, a) = self.centroid(grid, region, empty), self.centroid(last, region, empty)
        return F.when(last.isNotNull(), F.sqrt((y - b) * (y - b) + (x - a) * (x - a)))

    def circle(self, part: float) -> Region:
        r, cy, cx = int(min(self.h, self.w) * part), self.h // 2, self.w // 2
        return lambda y, x: (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r

    def edges(self, part: float, corners_twice: bool = False) -> dict[str, Region]:
        """top, bottom, left and right; the corners are top's or bottom's, or of both sides with `corners_twice`."""
        a, b = int(self.h * part), int(self.w * part)
        inner = everywhere if corners_twice else lambda y, x: a <= y < self.h - a
        return {"top": lambda y, x: y < a, "bottom": lambda y, x: y >= self.h - a, "left": lambda y, x: inner(y, x) and x < b, "right": lambda y, x: inner(y, x) and x >= self.w - b}


EIGHT = Shape()


def with_last(frames: DataFrame) -> DataFrame:
    """Adds the grids of the last frame and of the one before it, the frame's place in its window, and the window's frames."""
    w = Window.partitionBy("window_id").orderBy("frame_id")
    d = frames.withColumn("last", F.lag("grid").over(w)).withColumn("before", F.lag("grid", 2).over(w))
    return d.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("window_id")))


@dataclass
class Detector:
    """Names of `frame` and `total` are the detector's own; `out` holds columns of a window that fires, confidence and flags (an array)
    among them. `until` names a boolean of the frame whose first true one ends the window."""

    name: str
    least: int
    frame: dict[str, Column]
    total: dict[str, Callable]
    fires: Callable
    out: dict[str, Callable]
    until: str | None = None
    texts: tuple[str, ...] = ("flags",)


def _part(moves: Column, size: int) -> Column:
    """Part of `size` cells that moved, over the frames compared: whole counts and one division, so that equal parts are equal numbers."""
    frames = F.count(moves)
    return F.when(frames > 0, F.sum(moves) / (frames * size) if size else F.lit(0.0))


def _flags(**when: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, k) for k, c in when.items()]))


def _measured(frames: DataFrame, detectors: list[Detector]) -> DataFrame:
    """A row a window with the totals of all detectors, named detector_total, and `n`."""
    d = with_last(frames)
    for det in detectors:
        d = d.withColumns({f"{det.name}_{k}": c for k, c in det.frame.items()})
    for det in detectors:
        if det.until:
            end = F.min(F.when(F.col(f"{det.name}_{det.until}"), F.col("i"))).over(Window.partitionBy("window_id"))
            d = d.withColumn(f"{det.name}_end", end)
            past = F.col(f"{det.name}_end").isNotNull() & (F.col("i") > F.col(f"{det.name}_end"))
            d = d.withColumns({f"{det.name}_{k}": F.when(~past, F.col(f"{det.name}_{k}")) for k in det.frame})
    totals = [c(_names(det, det.frame)).alias(f"{det.name}__{k}") for det in detectors for k, c in det.total.items()]
    return d.groupBy("window_id").agg(F.first("n").alias("n"), *totals)


def _names(det: Detector, frame=()) -> Callable[[str], Column]:
    """A look-up of the detector's names: of the frame's columns while these are added up, else of the totals."""
    return lambda k: F.col(f"{det.name}_{k}") if k in frame else F.col(f"{det.name}__{k}")


def _result(det: Detector) -> tuple[Column, dict[str, Column]]:
    names = _names(det)
    fires = (F.col("n") >= det.least) & det.fires(names)
    return F.coalesce(fires, F.lit(False)), {k: c(names) for k, c in det.out.items()}


def detect(frames: DataFrame, det: Detector, texts: bool = True) -> DataFrame:
    """A row for each window that the detector fires on; arrays as comma-joined texts unless `texts` is false."""
    fires, out = _result(det)
    cols = [F.array_join(c, ",").alias(k) if texts and k in det.texts else F.round(c, 6).alias(k) if k not in det.texts + ("edge",) else c.alias(k) for k, c in out.items()]
    return _measured(frames, [det]).where(fires).select("window_id", *cols)


def run_all(frames: DataFrame, detectors: list[Detector]) -> DataFrame:
    """(window_id, operator, confidence, flags): a row for each detector that fires on a window, all with one shuffle."""
    found = []
    for det in detectors:
        fires, out = _result(det)
        flags = out["flags"] if "flags" in out and "flags" in det.texts else F.array().cast("array<string>")
        found.append(F.when(fires, F.struct(F.lit(det.name).alias("operator"), F.round(out["confidence"], 6).cast("double").alias("confidence"), flags.alias("flags"))))
    return _measured(frames, detectors).select("window_id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("window_id", "r.*")


def fingerprint(frames: DataFrame, shape: Shape = EIGHT) -> DataFrame:
    """One row a window: the confidences of five detectors, 0 where one is silent, the highest, and which fired, in their order."""
    five = {"flicker": flicker_of(shape), "hud": hud_of(shape), "crosshair": crosshair_motion_of(shape), "flash": peripheral_flash_of(shape), "color": color_shift_of(shape)}
    results = {k: _result(d) for k, d in five.items()}
    score = {k: F.round(F.when(fires, out["confidence"]).otherwise(0.0), 6) for k, (fires, out) in results.items()}
    fired = F.array_join(F.array_compact(F.array(*[F.when(results[k][0], five[k].name) for k in five])), ",")
    out = _measured(frames, list(five.values())).select("window_id", *[c.alias(k) for k, c in score.items()], fired.alias("detections"))
    return out.withColumn("overall", F.greatest(*five))


def flicker_of(shape: Shape = EIGHT, jump: int = 2, flips: int = 3, part: float = 0.05, full: float = 0.5) -> Detector:
    flip = F.when(F.col("last").isNotNull(), F.zip_with("grid", "last", lambda a, b: (F.abs(a - b) >= jump).cast("int")))
    cells = shape.h * shape.w
    zero = F.array_repeat(F.lit(0), cells)

    def ratio(c) -> Column:  # flips per cell, added up over the frames of a window
        each = F.aggregate(F.collect_list(c("flip")), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        return F.size(F.filter(each, lambda v: v >= flips)) / cells

    return Detector("flicker", 3, {"flip": flip}, {"ratio": ratio}, lambda c: c("ratio") > part, {"ratio": lambda c: c("ratio"), "confidence": lambda c: F.least(F.lit(1.0), c("ratio") / full)})


def flicker(frames: DataFrame, jump: int = 2, flips: int = 3, part: float = 0.05, full: float = 0.5, shape: Shape = EIGHT) -> DataFrame:
    """Windows of three frames or more where over `part` of the cells jump `flips` times or more."""
    return detect(frames, flicker_of(shape, jump, flips, part, full))


def flicker_base(frames: DataFrame, shape: Shape = EIGHT) -> DataFrame:
    """The plain variant: full confidence at a tenth of the cells."""
    return flicker(frames, full=0.1, shape=shape)


def hud_of(shape: Shape = EIGHT, regions: dict[str, Region] | None = None, alert: float = 0.02) -> Detector:
    regions = regions or {"bottom": lambda y, x: y >= shape.h - max(1, shape.h // 8), "top": lambda y, x: y < max(1, shape.h // 8)}
    names = [n for n in sorted(regions) if shape.size(regions[n])]
    moves = {n: shape.moves(F.col("grid"), F.col("last"), regions[n], 1) for n in names}
    most = lambda c: F.greatest(*[c(n) for n in names]) if len(names) > 1 else c(names[0])
    part = lambda n: lambda c: _part(c(n), shape.size(regions[n]))
    out = {"instability": most, "confidence": lambda c: F.least(F.lit(1.0), most(c) / (5 * alert)), "unstable": lambda c: _flags(**{n: c(n) > alert for n in names})}
    return Detector("hud_stability", 2, moves, {n: part(n) for n in names}, lambda c: most(c) > alert, out, texts=("unstable",))


def region(shape: Shape, top: float, height: float, left: float | None = None, width: float | None = None) -> Region:
    """A bar, or a rectangle, by parts of the frame."""
    y0, y1 = int(top * shape.h), min(shape.h, int((top + height) * shape.h))
    if left is None:
        return lambda y, x: y0 <= y < y1
    x0, x1 = int(left * shape.w), min(shape.w, int((left + width) * shape.w))
    return lambda y, x: y0 <= y < y1 and x0 <= x < x1


def hud_stability(frames: DataFrame, regions: dict[str, Region] | None = None, alert: float = 0.02, shape: Shape = EIGHT) -> DataFrame:
    """Windows of which some region changes in over `alert` of the comparisons of its cells."""
    return detect(frames, hud_of(shape, regions, alert))


def peripheral_flash_of(shape: Shape = EIGHT, edge: float = 0.15, jump: int = 3, alert: float = 0.03) -> Detector:
    edges = shape.edges(edge)
    size = {n: shape.size(r) for n, r in edges.items()}
    moves = {n: shape.moves(F.col("grid"), F.col("last"), r, jump) for n, r in edges.items()}
    part = lambda n: lambda c: _part(c(n), size[n])
    most = lambda c: F.greatest(*[c(n) for n in edges])

    def which(c) -> Column:
        out = F.lit("right")
        for n in ("left", "bottom", "top"):
            out = F.when(c(n) == most(c), n).otherwise(out)
        return out

    total = {n: part(n) for n in edges} | {"whole": lambda c: _part(sum((c(n) for n in edges), F.lit(0)), sum(size.values()))}
    out = {"flash": most, "overall": lambda c: c("whole"), "edge": which, "confidence": lambda c: F.least(F.lit(1.0), most(c) / alert)}
    return Detector("peripheral_flash", 2, moves, total, lambda c: most(c) > alert, out, texts=())


def peripheral_flash(frames: DataFrame, edge: float = 0.15, jump: int = 3, alert: float = 0.03, shape: Shape = EIGHT) -> DataFrame:
    """Windows where over `alert` of an edge's comparisons, over all frames, are jumps; the edge with most, the first of top, bottom,
    left and right on ties; corners are top's or bottom's."""
    return detect(frames, peripheral_flash_of(shape, edge, jump, alert))


def _histogram(grid: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.coalesce(F.size(F.filter(grid, lambda v: v == b)), F.lit(0)))


def _moved(steps: Column) -> Column:
    """Earth mover's distance of two histograms, from the differences of their bins, added up in the order of the bins."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("total"))
    add = lambda a, d: F.struct((a["upto"] + d).alias("upto"), (a["total"] + F.abs(a["upto"] + d)).alias("total"))
    return F.aggregate(steps, start, add, lambda a: a["total"])


def color_shift_of(shape: Shape = EIGHT, alert: float = 0.3) -> Detector:
    cells = shape.h * shape.w
    step = _moved(F.zip_with(_histogram(F.col("grid")), _histogram(F.col("last")), lambda a, b: (a - b) / cells))
    frame = {"h": _histogram(F.col("grid")), "early": F.col("i") < F.floor(F.col("n") / 2), "step": F.when(F.col("last").isNotNull(), step)}
    # cells of a half by bin: whole counts, divided once, so that the distance does not depend on the order of the frames
    half = lambda early: lambda c: F.array(*[F.sum(F.when(c("early") == early, c("h")[b])) / F.nullif(F.count_if(c("early") == early) * cells, F.lit(0)) for b in range(10)])
    total = {"a": half(True), "b": half(False), "mean_step": lambda c: F.avg(c("step")), "max_step": lambda c: F.max(c("step"))}
    emd = lambda c: _moved(F.zip_with(c("a"), c("b"), lambda p, q: p - q))
    out = {"emd": emd, "mean_frame_emd": lambda c: c("mean_step"), "max_frame_emd": lambda c: c("max_step"), "confidence": lambda c: F.least(F.lit(1.0), emd(c) / alert)}
    return Detector("color_shift", 10, frame, total, lambda c: emd(c) > alert, out, texts=())


def color_shift(frames: DataFrame, alert: float = 0.3, shape: Shape = EIGHT) -> DataFrame:
    """Earth mover's distance between the mean histograms of the first n // 2 frames and the rest, for 10 frames or more; and the mean
    and highest distance between neighbouring frames."""
    return detect(frames, color_shift_of(shape, alert))


def crosshair_motion_of(shape: Shape = EIGHT, smooth: float = 0.95, snap: float = 0.1, far: float = 5.0) -> Detector:
    centre = region(shape, 0.35, 0.30, 0.35, 0.30)
    half = shape.size(centre) // 2
    frame = {"step": shape.step(F.col("grid"), F.col("last"), centre, (half, half)), "past": shape.step(F.col("last"), F.col("before"), centre, (half, half))}
    turn = lambda c: (c("step") > 0.5) & (c("past") > 0.5) & (F.abs(c("step") - c("past")) > 1)
    total = {"variance": lambda c: F.var_pop(c("step")), "snaps": lambda c: F.count_if(c("step") > far), "m": lambda c: F.count(c("step")), "turns": lambda c: F.count_if(turn(c)), "mean": lambda c: F.avg(c("step"))}
    smoothness, snaps = (lambda c: 1 / (1 + c("variance"))), (lambda c: c("snaps") / c("m"))
    confidence = lambda c: F.greatest(F.when(smoothness(c) > smooth, (smoothness(c) - smooth) / (1 - smooth)).otherwise(0.0), F.when(snaps(c) > snap, F.least(F.lit(1.0), 5 * snaps(c))).otherwise(0.0))
    out = {"smoothness": smoothness, "snap_score": snaps, "stutter_score": lambda c: c("turns") / F.greatest(F.lit(1), c("m") - 1), "mean_motion": lambda c: c("mean"), "snap_count": lambda c: c("snaps"), "confidence": confidence}
    return Detector("crosshair_motion", 5, frame, total, lambda c: (smoothness(c) > smooth) | (snaps(c) > snap), out, texts=())


def crosshair_motion(frames: DataFrame, smooth: float = 0.95, snap: float = 0.1, far: float = 5.0, shape: Shape = EIGHT) -> DataFrame:
    """Windows of five frames or more in which the weight of the frame's middle moves too smoothly (1 / (1 + variance) over `smooth`) or
    snaps (steps over `far`, in over `snap` of them)."""
    return detect(frames, crosshair_motion_of(shape, smooth, snap, far))


def crosshair_lock_of(shape: Shape = EIGHT, radius: float = 0.05, enemy: tuple[int, int] = (5, 9), marker: int = 9) -> Detector:
    aim = shape.circle(radius)
    frame = {
        "on": shape.share(F.col("grid"), aim, *enemy) > 0.2, "hit": shape.share(F.col("grid"), aim, marker, marker) > 0.1,
        "step": shape.step(F.col("grid"), F.col("last"), everywhere, (shape.h // 2, shape.w // 2)),
    }
    total = {
        "frames": lambda c: F.count(F.lit(1)), "on_n": lambda c: F.count_if(c("on")), "hits": lambda c: F.count_if(c("hit")), "moves": lambda c: F.count(c("step")),
        "m_on": lambda c: F.avg(F.when(c("on"), c("step"))), "m_off": lambda c: F.avg(F.when(~c("on"), c("step"))), "m_all": lambda c: F.avg(c("step")),
    }

    def resistance(c) -> Column:
        r = F.when((c("moves") >= 5) & (c("m_off") > 0), c("m_on") / c("m_off"))
        return F.coalesce(F.when(r < 0.7, (0.7 - r) / 0.7).when(r > 1, F.least(F.lit(1.0), r - 1)), F.lit(0.0))

    def drift(c) -> Column:
        e = c("hits") / c("on_n")
        return F.when((c("on_n") > 5) & (e < 0.2), (0.2 - e) / 0.2).when((c("on_n") > 5) & (e > 0.6), (e - 0.6) / 0.4).otherwise(0.0)

    out = {
        "on_target": lambda c: c("on_n"), "hits": lambda c: c("hits"), "intersection": lambda c: c("on_n") / c("frames"), "efficiency": lambda c: c("hits") / c("on_n"), "resistance": resistance,
        "mean_motion": lambda c: F.coalesce(c("m_all"), F.lit(0.0)), "confidence": lambda c: F.least(F.lit(1.0), F.greatest(resistance(c), drift(c))), "flags": lambda c: _flags(AIM_RESISTANCE=resistance(c) > 0.3, HITBOX_DRIFT=drift(c) > 0.5),
    }
    return Detector("crosshair_lock", 5, frame, total, lambda c: c("on_n") >= 3, out)


def crosshair_lock(frames: DataFrame, shape: Shape = EIGHT, **bounds) -> DataFrame:
    """Windows of five frames or more with three or more on target: how the frame's motion slows on target against off it, and the hit
    markers of all frames for each frame on target. AIM_RESISTANCE follows the one, HITBOX_DRIFT the other."""
    return detect(frames, crosshair_lock_of(shape, **bounds))


def hit_registration_of(shape: Shape = EIGHT, marker: int = 9, blood: tuple[int, int] = (7, 8), ghost: float = 0.3) -> Detector:
    centre, middle = shape.circle(0.15), shape.circle(0.2)
    outer = lambda y, x: not middle(y, x)

    def confirm(grid: Column, last: Column) -> Column:
        return (shape.share(grid, everywhere, *blood) > 0.02) | F.coalesce(shape.changed(grid, last, outer, 1) > 0.1, F.lit(False))

    frame = {"marker": shape.share(F.col("grid"), centre, marker, marker) > 0.05, "confirm": confirm(F.col("grid"), F.col("last"))}
    # the frames of a window in order, as bits: a marker is confirmed in its frame or the two after it
    rows = lambda c: F.array_sort(F.collect_list(F.struct("i", c("marker").alias("m"), c("confirm").alias("d"))))
    ghosts = lambda c: F.size(F.filter(c("rows"), lambda r: r["m"] & ~F.exists(F.slice(c("rows"), r["i"] + 1, 3), lambda s: s["d"])))
    total = {"rows": rows, "markers": lambda c: F.count_if(c("marker")), "confirms": lambda c: F.count_if(c("confirm")), "first": lambda c: F.min(F.when(c("marker"), F.col("i"))), "final": lambda c: F.max(F.when(c("marker"), F.col("i")))}
    ratio = lambda c: ghosts(c) / c("markers")
    out = {
        "markers": lambda c: c("markers"), "ghosts": ghosts, "ghost_ratio": ratio, "mean_gap": lambda c: F.when(c("markers") > 1, (c("final") - c("first")) / (c("markers") - 1)).otherwise(0.0), "confirmed_frames": lambda c: c("confirms"),
        "confidence": lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio(c) - ghost) / (1 - ghost))), "flags": lambda c: _flags(GHOST_HITS=ratio(c) > ghost, DAMAGE_SUPPRESSION=ratio(c) > 0.5),
    }
    return Detector("hit_registration", 5, frame, total, lambda c: c("markers") > 0, out)


def hit_registration(frames: DataFrame, shape: Shape = EIGHT, **bounds) -> DataFrame:
    """Windows of five frames or more with hit markers: those without blood, or a change of the outer cells, in their frame or the two
    after it, and the mean gap between markers."""
    return detect(frames, hit_registration_of(shape, **bounds))


def death_event_of(shape: Shape = EIGHT, blood: tuple[int, int] = (7, 8), edge: float = 0.1, corner: float = 0.1, screen: int = 9, shaken: float = 0.1) -> Detector:
    sides = shape.edges(edge, corners_twice=True)
    c = int(min(shape.h, shape.w) * corner)
    corners = lambda y, x: (y < c or y >= shape.h - c) and (x < c or x >= shape.w - c)
    mean = lambda power: F.aggregate(F.col("grid"), F.lit(0.0), lambda a, v: a + (v if power == 1 else v * v)) / F.size("grid")
    shake = F.aggregate(F.zip_with("grid", "last", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v) / (9.0 * shape.h * shape.w)
    frame = {
        "hurt": F.greatest(*[shape.share(F.col("grid"), r, *blood) for r in sides.values()]) > 0.05,
        "shake": F.when(F.col("last").isNotNull() & (shake > shaken), shake),
        "dead": (mean(2) - mean(1) * mean(1) < 2.0) | (shape.count(F.col("grid"), corners, lambda v: v == screen) > c * c * 0.1),
    }
    total = {
        "damage": lambda q: F.count_if(q("hurt")), "first": lambda q: F.min(F.when(q("hurt"), F.col("i"))), "death": lambda q: F.min(F.when(q("dead"), F.col("i"))),
        "flinches": lambda q: F.count(q("shake")), "strength": lambda q: F.avg(q("shake")),
    }
    many = lambda q: q("flinches") > 10
    out = {
        "damage_frames": lambda q: q("damage"), "first_hit": lambda q: q("first"), "death_frame": lambda q: q("death"), "frames_to_death": lambda q: q("death") - q("first"), "flinches": lambda q: q("flinches"),
        "flinch_strength": lambda q: F.coalesce(q("strength"), F.lit(0.0)), "confidence": lambda q: F.when(many(q), F.least(F.lit(1.0), q("flinches") / 20)).otherwise(0.0), "flags": lambda q: _flags(INCOMING_DAMAGE_SPIKE=many(q)),
    }
    return Detector("death_event", 5, frame, total, lambda q: q("damage") > 0, out, until="dead")


def death_event(frames: DataFrame, shape: Shape = EIGHT, **bounds) -> DataFrame:
    """Windows of five frames or more with damage on an edge, up to the death screen (cells alike, or marks in the corners): frames from the
    first damage to it, null without one, and flinches, of which more than 10 make the confidence."""
    return detect(frames, death_event_of(shape, **bounds))


def edge_entry_of(shape: Shape = EIGHT, edge: float = 0.15, enemy: tuple[int, int] = (5, 9), entry: float = 0.05, rear: float = 0.4, rate: float = 3.0) -> Detector:
    zones = dict(zip(("rear", "front", "left", "right"), shape.edges(edge).values(), strict=True))
    grew = {n: F.coalesce(F.when(F.col("last").isNotNull(), shape.share(F.col("grid"), r, *enemy) - shape.share(F.col("last"), r, *enemy) > entry), F.lit(False)).cast("int") for n, r in zones.items()}
    frame = grew | {"any": sum(grew.values(), F.lit(0))}
    total = {n: (lambda m: lambda c: F.sum(c(m)))(n) for n in zones} | {
        "all": lambda c: F.sum(c("any")), "first": lambda c: F.min(F.when(c("any") > 0, F.col("i"))), "final": lambda c: F.max(F.when(c("any") > 0, F.col("i"))),
        "seconds": lambda c: (F.max("t_us") - F.min("t_us")) / 1e6,
    }
    part = lambda c: F.col("edge_entry__rear") / c("all")
    speed = lambda c: F.when(c("seconds") > 0, c("all") / c("seconds")).otherwise(0.0)
    gap = lambda c: F.when(c("all") > 1, (c("final") - c("first")) / (c("all") - 1)).otherwise(0.0)
    close = lambda c: (gap(c) < 5) & (c("all") > 3)
    confidence = lambda c: F.least(F.lit(1.0), F.greatest(F.when(part(c) > rear, (part(c) - rear) / (1 - rear)).otherwise(0.0), F.when(speed(c) > rate, F.least(F.lit(1.0), (speed(c) - rate) / rate)).otherwise(0.0), F.when(close(c), 0.5).otherwise(0.0)))
    out = {
        "entries": lambda c: c("all"), "rear": lambda c: c("rear"), "front": lambda c: c("front"), "side": lambda c: c("left") + c("right"), "rate": speed, "mean_gap": gap, "clustered": lambda c: close(c).cast("int"),
        "confidence": confidence, "flags": lambda c: _flags(SPAWN_PRESSURE=part(c) > rear, SPAWN_BIAS=speed(c) > rate),
    }
    return Detector("edge_entry", 3, frame, total, lambda c: c("all") > 0, out)


def edge_entry(frames: DataFrame, shape: Shape = EIGHT, **bounds) -> DataFrame:
    """Windows of three frames or more (with t_us) in which enemy cells enter over an edge: entries by direction (rear is the top, front
    the bottom), their rate a second, the mean gap in frames and whether they cluster."""
    return detect(frames, edge_entry_of(shape, **bounds))


def all_detectors(shape: Shape = EIGHT) -> list[Detector]:
    return [f(shape) for f in (flicker_of, hud_of, crosshair_motion_of, peripheral_flash_of, color_shift_of, crosshair_lock_of, hit_registration_of, death_event_of, edge_entry_of)]


def count_windows(frames: DataFrame, size: int = 30, by: str = "source", order: str = "frame_id") -> DataFrame:
    """Cuts each source's frames into windows of `size` in their order; an unfinished last one is left out. Adds window_id and frame_id."""
    w = Window.partitionBy(by).orderBy(order)
    d = frames.withColumn("_at", F.row_number().over(w) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(by)))
    d = d.where(F.col("_at") < F.floor(F.col("_all") / size) * size)
    return d.withColumn("window_id", F.floor(F.col("_at") / size)).withColumn("frame_id", F.col("_at") % size).drop("_at", "_all")
