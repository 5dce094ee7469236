"""Color space expressions from the published sRGB, CIE Lab and HSV definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ (D65) and back, white point, luma weights.
RGB_TO_XYZ = [
    [0.412453, 0.357580, 0.180423],
    [0.212671, 0.715160, 0.072169],
    [0.019334, 0.119193, 0.950227],
]
XYZ_TO_RGB = [
    [3.24048134, -1.53715152, -0.49853633],
    [-0.96925495, 1.87599, 0.04155593],
    [0.05564664, -0.20404134, 1.05731107],
]
WHITE = [0.95047, 1.0, 1.08883]
LUMA = [0.299, 0.587, 0.114]

# The finishing pass.
COOL_A, COOL_B = 5, 10
SATURATION_GAIN, VALUE_GAIN = 1.3, 1.1
CONTRAST, BRIGHTNESS = 1.2, 10
WARM_A, WARM_B = 132, 135

# Keeps a value that is a whole number up to rounding noise from being cut to the one below.
NUDGE = 1e-6


def clip(col: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def to_byte(col: Column) -> Column:
    """Cut, not rounded, to 0..255."""
    return F.floor(clip(col + NUDGE)).cast("int")


def nearest_byte(col: Column) -> Column:
    """Rounded half to even and clipped to 0..255."""
    return clip(F.rint(col)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return nearest_byte(F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b)


def _linear(c: Column) -> Column:
    c = c / F.lit(255.0)
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def _lab_curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def _mix(row: list[float], x: Column, y: Column, z: Column) -> Column:
    return x * row[0] + y * row[1] + z * row[2]


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", names=("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Add CIE L (0..100), a and b as doubles."""
    df = df.withColumns({f"__lin_{i}": _linear(F.col(c)) for i, c in enumerate((r, g, b))})
    lin = [F.col(f"__lin_{i}") for i in range(3)]
    df = df.withColumns({f"__f_{i}": _lab_curve(_mix(RGB_TO_XYZ[i], *lin) / WHITE[i]) for i in range(3)})
    fx, fy, fz = (F.col(f"__f_{i}") for i in range(3))
    df = df.withColumns({names[0]: fy * 116.0 - 16.0, names[1]: (fx - fy) * 500.0, names[2]: (fy - fz) * 200.0})
    return df.drop(*[f"__lin_{i}" for i in range(3)], *[f"__f_{i}" for i in range(3)])


def with_rgb_from_lab(df: DataFrame, l: str, a: str, b: str, names=("r", "g", "b")) -> DataFrame:
    """Add r, g, b in 0..1 for CIE L, a, b."""
    fy = (F.col(l) + 16.0) / 116.0
    df = df.withColumns(
        {"__f_0": F.col(a) / 500.0 + fy, "__f_1": fy, "__f_2": F.greatest(fy - F.col(b) / 200.0, F.lit(0.0))}
    )

    def back(t: Column, white: float) -> Column:
        return F.when(t > 0.2068966, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787) * white

    df = df.withColumns({f"__x_{i}": back(F.col(f"__f_{i}"), WHITE[i]) for i in range(3)})
    xyz = [F.col(f"__x_{i}") for i in range(3)]
    df = df.withColumns({f"__l_{i}": _mix(XYZ_TO_RGB[i], *xyz) for i in range(3)})

    def companded(c: Column) -> Column:
        high = F.pow(F.greatest(c, F.lit(0.0031308)), F.lit(1 / 2.4)) * 1.055 - 0.055
        return clip(F.when(c > 0.0031308, high).otherwise(c * 12.92), 0.0, 1.0)

    df = df.withColumns({n: companded(F.col(f"__l_{i}")) for i, n in enumerate(names)})
    return df.drop(*[f"__{k}_{i}" for k in "fxl" for i in range(3)])


def with_hsv(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", names=("hsv_h", "hsv_s", "hsv_v")) -> DataFrame:
    """Add 8-bit hue (half degrees, 0..179), saturation and value."""
    red, green, blue = F.col(r), F.col(g), F.col(b)
    df = df.withColumns({"__v": F.greatest(red, green, blue), "__d": F.greatest(red, green, blue) - F.least(red, green, blue)})
    v, d = F.col("__v"), F.col("__d")
    degrees = (
        F.when(d == 0, F.lit(0.0))
        .when(v == red, (green - blue) * 60.0 / d)
        .when(v == green, (blue - red) * 60.0 / d + 120.0)
        .otherwise((red - green) * 60.0 / d + 240.0)
    )
    half = F.rint(F.when(degrees < 0, degrees + 360.0).otherwise(degrees) / 2.0).cast("int")
    df = df.withColumns(
        {
            names[0]: half % 180,
            names[1]: F.when(v == 0, F.lit(0)).otherwise(F.rint(d * 255.0 / v).cast("int")),
            names[2]: v,
        }
    )
    return df.drop("__v", "__d")


def with_bgr_from_hsv(df: DataFrame, h: str, s: str, v: str, names=("b", "g", "r")) -> DataFrame:
    """Add 8-bit b, g, r for 8-bit hue, saturation and value."""
    hue = F.col(h) / 30.0
    sat, val = F.col(s) / 255.0, F.col(v).cast("double")
    df = df.withColumns({"__i": F.floor(hue), "__part": hue - F.floor(hue), "__s": sat, "__val": val})
    part, s_, v_ = F.col("__part"), F.col("__s"), F.col("__val")
    df = df.withColumns(
        {"__p": v_ * (F.lit(1.0) - s_), "__q": v_ * (F.lit(1.0) - s_ * part), "__t": v_ * (F.lit(1.0) - s_ * (F.lit(1.0) - part))}
    )
    # Which term each of r, g, b takes in the six sectors of the hue circle.
    sectors = {"r": "vqpptv", "g": "tvvqpp", "b": "pptvvq"}
    term = {"v": v_, "p": F.col("__p"), "q": F.col("__q"), "t": F.col("__t")}

    def channel(c: str) -> Column:
        out = term[sectors[c][5]]
        for i in range(4, -1, -1):
            out = F.when(F.col("__i") == i, term[sectors[c][i]]).otherwise(out)
        return nearest_byte(out)

    df = df.withColumns({n: channel(c) for n, c in zip(names, "bgr")})
    return df.drop("__i", "__part", "__s", "__val", "__p", "__q", "__t")


def eq_tone(v: Column, contrast: float = 1.15, brightness: float = 0.02) -> Column:
    """Contrast around mid gray plus a brightness share of full scale."""
    return to_byte((v - 127.5) * contrast + 127.5 + 255.0 * brightness)


def scale_abs(v: Column, alpha: float = CONTRAST, beta: float = BRIGHTNESS) -> Column:
    return nearest_byte(F.abs(v * alpha + beta))
