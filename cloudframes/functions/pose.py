"""Cameras from pose encodings, and points from pixels, as column expressions that stay in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FRUSTUM_DEPTH = 0.15


def quat_to_mat(x: Column, y: Column, z: Column, w: Column) -> dict[str, Column]:
    """Rotation of a scalar-last quaternion of any length; the zero quaternion gives the identity."""
    n = x * x + y * y + z * z + w * w
    s = F.when(n > 0, F.lit(2.0) / n).otherwise(0.0)
    return {
        "r00": 1 - s * (y * y + z * z), "r01": s * (x * y - z * w), "r02": s * (x * z + y * w),
        "r10": s * (x * y + z * w), "r11": 1 - s * (x * x + z * z), "r12": s * (y * z - x * w),
        "r20": s * (x * z - y * w), "r21": s * (y * z + x * w), "r22": 1 - s * (x * x + y * y),
    }


def decode_pose(enc: Column, width: Column, height: Column) -> dict[str, Column]:
    """World-to-camera rotation and translation, and intrinsics, of nine numbers: translation, quaternion, vertical and horizontal field of view."""
    e = [F.get(enc, k).cast("double") for k in range(9)]
    return {
        **quat_to_mat(*e[3:7]), "t0": e[0], "t1": e[1], "t2": e[2],
        "fx": width / 2 / F.tan(e[8] / 2), "fy": height / 2 / F.tan(e[7] / 2), "cx": width / F.lit(2.0), "cy": height / F.lit(2.0),
    }


def _c(name: str, prefix: str = "") -> Column:
    return F.col(prefix + name)


def unproject(px: Column, py: Column, depth: Column) -> list[Column]:
    """World x, y, z of a pixel at a depth, with the camera's columns beside it."""
    q = [(px - _c("cx")) / _c("fx") * depth - _c("t0"), (py - _c("cy")) / _c("fy") * depth - _c("t1"), depth - _c("t2")]
    return [_c(f"r0{k}") * q[0] + _c(f"r1{k}") * q[1] + _c(f"r2{k}") * q[2] for k in range(3)]


def project(x: Column, y: Column, z: Column) -> list[Column]:
    """Pixel x, y and depth of a world point."""
    cam = [_c(f"r{k}0") * x + _c(f"r{k}1") * y + _c(f"r{k}2") * z + _c(f"t{k}") for k in range(3)]
    return [cam[0] / cam[2] * _c("fx") + _c("cx"), cam[1] / cam[2] * _c("fy") + _c("cy"), cam[2]]


def camera_center() -> list[Column]:
    """Where the camera stands in the world."""
    return [-(_c(f"r0{k}") * _c("t0") + _c(f"r1{k}") * _c("t1") + _c(f"r2{k}") * _c("t2")) for k in range(3)]


def frusta_corners(width: Column, height: Column, depth: float = FRUSTUM_DEPTH) -> Column:
    """Four image corners in the viewer's axes (x, -y, -z), in order around the image."""
    zero, d = F.lit(0.0), F.lit(depth)
    out = []
    for k, (px, py) in enumerate(((zero, zero), (width, zero), (width, height), (zero, height))):
        x, y, z = unproject(px, py, d)
        out.append(F.struct(F.lit(k).alias("corner"), x.alias("x"), (-y).alias("y"), (-z).alias("z")))
    return F.array(*out)
