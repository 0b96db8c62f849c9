"""Boxes and crops as columns. A box is a struct of x, y, w, h; a crop is one too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewell.functions.binding import let, let_all


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``low`` wins if the bounds cross."""
    return F.greatest(low, F.least(high, value))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def center(b: Column) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def expand(b: Column, pad: float) -> Column:
    """Pad a box; x and y stop at 0, width and height always grow by twice the padding."""
    return box(F.greatest(F.lit(0.0), b.x - pad), F.greatest(F.lit(0.0), b.y - pad), b.w + 2 * pad, b.h + 2 * pad)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for an empty union."""
    shared = intersection(a, b)
    total = a.w * a.h + b.w * b.h - shared
    return F.when((shared <= 0) | (total <= 0), F.lit(0.0)).otherwise(F.try_divide(shared, total))


def center_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def visibility(crop: Column, face: Column) -> Column:
    """The share of a face inside a crop."""
    return F.when(face.w * face.h > 0, F.try_divide(intersection(crop, face), face.w * face.h)).otherwise(F.lit(0.0))


def union(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for an empty array."""

    def around(bs: Column) -> Column:
        left, top = F.array_min(F.transform(bs, lambda b: b.x)), F.array_min(F.transform(bs, lambda b: b.y))
        right, bottom = F.array_max(F.transform(bs, lambda b: b.x + b.w)), F.array_max(F.transform(bs, lambda b: b.y + b.h))
        made = let_all(lambda l, t, r, b: box(l, t, r - l, b - t), l=left, t=top, r=right, b=bottom)
        return F.when(F.size(bs) > 0, made)

    return let(boxes, around)


def largest_crop(width: Column, height: Column, aspect: float) -> tuple[Column, Column]:
    """The largest crop of an aspect inside a frame."""
    fits = height * aspect <= width
    return F.when(fits, height * aspect).otherwise(width), F.when(fits, height).otherwise(width / aspect)


def content_crop(w: Column, h: Column, aspect: float) -> Column:
    """The smallest crop of an aspect around a content, as a struct of w and h; 1 by 1 around nothing."""

    def made(w: Column, h: Column) -> Column:
        none, wide = (w <= 0) | (h <= 0), F.try_divide(w, h) > aspect
        size = lambda a, b: F.struct(a.alias("w"), b.alias("h"))
        return F.when(none, size(F.lit(1.0), F.lit(1.0))).when(wide, size(w, w / aspect)).otherwise(size(h * aspect, h))

    return let_all(made, w=w, h=h)


def crop_at(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A crop around a center, moved into the frame."""
    return box(clamp(cx, w / 2, width - w / 2) - w / 2, clamp(cy, h / 2, height - h / 2) - h / 2, w, h)


def fit_crop(crop: Column, width: Column, height: Column, aspect: float) -> Column:
    """A crop brought to the aspect and into the frame."""

    def sized(c: Column) -> Column:
        size = lambda w, h: F.struct(F.least(w, width).alias("w"), F.least(h, height).alias("h"))
        shaped = lambda w, h: F.when(w / h > aspect, size(w, w / aspect)).otherwise(size(h * aspect, h))
        cx, cy = center(c)
        placed = lambda s: box(clamp(cx - s.w / 2, F.lit(0.0), width - s.w), clamp(cy - s.h / 2, F.lit(0.0), height - s.h), s.w, s.h)
        return let(let_all(shaped, w=F.least(width, c.w), h=F.least(height, c.h)), placed)

    return let(crop, sized)


def include(at: Column, half: Column, low: Column, high: Column) -> Column:
    """A center moved so that its extent takes in ``low`` and then ``high``, both judged from where it was."""
    return at + F.when(low < at - half, low - (at - half)).otherwise(F.lit(0.0)) + F.when(high > at + half, high - (at + half)).otherwise(F.lit(0.0))


def pan_to(crop: Column, content: Column, width: Column, height: Column) -> Column:
    """A crop of fixed size moved to take in a content box, within the frame."""

    def moved(crop: Column, content: Column) -> Column:
        cx, cy = center(crop)
        x = clamp(include(cx, crop.w / 2, content.x, content.x + content.w), crop.w / 2, width - crop.w / 2)
        y = clamp(include(cy, crop.h / 2, content.y, content.y + content.h), crop.h / 2, height - crop.h / 2)
        return box(x - crop.w / 2, y - crop.h / 2, crop.w, crop.h)

    return let_all(moved, crop=crop, content=content)


def face_safe(crop: Column, faces: Column, width: Column, height: Column, aspect: float, pad: float) -> Column:
    """A crop grown and moved so that all padded faces are inside; without faces it is only fitted to the frame."""

    def held(crop: Column, content: Column) -> Column:
        small = (content.w > crop.w) | (content.h > crop.h)
        grown = lambda c: F.struct(F.least(c.w, width).alias("w"), F.least(c.h, height).alias("h"))
        size = F.when(small, let(content_crop(content.w, content.h, aspect), grown)).otherwise(F.struct(crop.w.alias("w"), crop.h.alias("h")))
        cx, cy = center(crop)

        def placed(s: Column) -> Column:
            x = clamp(include(cx, s.w / 2, content.x, content.x + content.w), s.w / 2, width - s.w / 2)
            y = clamp(include(cy, s.h / 2, content.y, content.y + content.h), s.h / 2, height - s.h / 2)
            return box(x - s.w / 2, y - s.h / 2, s.w, s.h)

        return let(size, placed)

    around = union(F.transform(faces, lambda b: expand(b, pad)))
    return F.when(F.size(faces) > 0, let_all(held, crop=crop, content=around)).otherwise(fit_crop(crop, width, height, aspect))


def framing(faces: Column, width: Column, height: Column, aspect: float, padding: float, forehead: float, thirds: float, zoom: Column) -> Column:
    """Center and size of a crop that frames faces with room above them; the whole frame without faces."""

    def made(bs: Column) -> Column:
        tall = F.aggregate(bs, F.lit(0.0), lambda a, b: a + b.h) / F.size(bs)

        def framed(around: Column, top: Column) -> Column:
            def placed(content_h: Column, w: Column, h: Column) -> Column:
                x, y = around.x + around.w / 2, top + content_h / 2 - h * thirds
                return F.struct(clamp(x, w / 2, width - w / 2).alias("cx"), clamp(y, h / 2, height - h / 2).alias("cy"), w.alias("w"), h.alias("h"))

            def zoomed(content_h: Column, c: Column) -> Column:
                return let_all(placed, content_h=content_h, w=F.least(width, c.w * zoom), h=F.least(height, c.h * zoom))

            return let(around.h + (around.y - top), lambda ch: let_all(zoomed, content_h=ch, c=content_crop(around.w, ch, aspect)))

        return let(expand(union(bs), padding), lambda a: let_all(framed, around=a, top=F.greatest(F.lit(0.0), a.y - tall * forehead)))

    whole = F.struct((width / 2).alias("cx"), (height / 2).alias("cy"), width.alias("w"), height.alias("h"))
    return let(faces, lambda bs: F.when(F.size(bs) > 0, made(bs)).otherwise(whole))


def frontal(face: Column, left_eye: Column, right_eye: Column, frame_area: Column) -> Column:
    """How frontal and large a face is; eyes are structs of x and y, or null."""
    dx, dy = right_eye.x - left_eye.x, right_eye.y - left_eye.y
    apart = F.sqrt(dx * dx + dy * dy)
    turned = F.when(apart > 0, F.lit(0.4) + F.lit(0.6) * F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(F.abs(dy), apart)))
    size = F.least(F.lit(1.0), face.w * face.h / F.greatest(frame_area * 0.08, F.lit(1.0)))
    return F.least(F.lit(1.0), F.coalesce(turned, F.lit(0.6)) * 0.7 + size * 0.3)
