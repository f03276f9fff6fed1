"""Vectors (3 doubles), row-major matrices (9 doubles), quaternions (x, y, z, w) and Euler angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def at(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def neg(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def length_squared(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def row(m: Column, i: int) -> Column:
    return F.slice(m, 3 * i + 1, 3)


def scale(m: Column) -> Column:
    """Row norms."""
    return F.array(*[length(row(m, i)) for i in range(3)])


def without_scale(m: Column) -> Column:
    """Rows of length 1; a zero row gives nulls."""
    norms = [length(row(m, i)) for i in range(3)]
    return F.array(*[at(m, 3 * i + j) / F.nullif(norms[i], F.lit(0.0)) for i in range(3) for j in range(3)])


def mul_mat(a: Column, b: Column) -> Column:
    return F.array(*[at(a, 3 * i) * at(b, j) + at(a, 3 * i + 1) * at(b, 3 + j) + at(a, 3 * i + 2) * at(b, 6 + j) for i in range(3) for j in range(3)])


def mul_vec(m: Column, v: Column) -> Column:
    return F.array(*[dot(row(m, i), v) for i in range(3)])


def _cofactor(m: Column, i: int, j: int) -> Column:
    a, b = [k for k in range(3) if k != i]
    c, d = [k for k in range(3) if k != j]
    minor = at(m, 3 * a + c) * at(m, 3 * b + d) - at(m, 3 * a + d) * at(m, 3 * b + c)
    return minor if (i + j) % 2 == 0 else -minor


def det(m: Column) -> Column:
    return at(m, 0) * _cofactor(m, 0, 0) + at(m, 1) * _cofactor(m, 0, 1) + at(m, 2) * _cofactor(m, 0, 2)


def inverse(m: Column) -> Column:
    """The inverse by the adjugate; null where |det| <= 1e-6."""
    d = det(m)
    return F.when(F.abs(d) > 1e-6, F.array(*[_cofactor(m, j, i) / d for i in range(3) for j in range(3)]))


def to_quat(m: Column) -> Column:
    """Quaternion (x, y, z, w) of a rotation.

    Four times the square of each component is 1 plus or minus the diagonal's elements, and four times the product of two components is the
    sum or difference of two elements across the diagonal. The largest component, of equal ones the last, is the root of its square, so that
    no small number divides; the products give the others.
    """
    # The diagonal's signs in the squares; row and column of the elements in the products, and the second one's sign.
    signs = {"x": (1, -1, -1), "y": (-1, 1, -1), "z": (-1, -1, 1), "w": (1, 1, 1)}
    products = {"xy": (0, 1, 1), "xz": (0, 2, 1), "yz": (1, 2, 1), "wx": (2, 1, -1), "wy": (0, 2, -1), "wz": (1, 0, -1)}
    cell = lambda r, c: at(m, 3 * r + c)
    square = {k: F.lit(1.0) + sum(s * cell(i, i) for i, s in enumerate(v)) for k, v in signs.items()}
    product = {frozenset(k): cell(r, c) + s * cell(c, r) for k, (r, c, s) in products.items()}
    largest = F.greatest(*square.values())

    def by(k: str) -> Column:
        root = F.sqrt(square[k])
        return F.array(*[root / 2 if n == k else product[frozenset((n, k))] / (2 * root) for n in signs])

    return F.when(square["w"] == largest, by("w")).when(square["z"] == largest, by("z")).when(square["y"] == largest, by("y")).otherwise(by("x"))


def to_euler(m: Column) -> Column:
    """Intrinsic XYZ angles (roll, pitch, yaw); yaw is 0 in gimbal lock."""
    pitch = F.asin(at(m, 2))
    free = F.abs(F.cos(pitch)) > 1e-6
    roll = F.when(free, F.atan2(-at(m, 5), at(m, 8))).otherwise(F.atan2(at(m, 3), at(m, 4)))
    return F.array(roll, pitch, F.when(free, F.atan2(-at(m, 1), at(m, 0))).otherwise(F.lit(0.0)))


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """The rotation matrix that `to_euler` takes apart."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(cp * cy, -cp * sy, sp, cr * sy + sr * sp * cy, cr * cy - sr * sp * sy, -sr * cp, sr * sy - cr * sp * cy, sr * cy + cr * sp * sy, cr * cp)
