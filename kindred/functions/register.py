"""SQL names for the image features and an HTML table function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions import image


def _on_images(f: Callable, kind: str):
    """An Arrow UDF from image bytes; null for what can't be decoded."""

    def run(data: pd.Series) -> pd.Series:
        out = []
        for body in data:
            img = image.decode(body)
            value = None if img is None else f(img)
            out.append(value.tolist() if hasattr(value, "tolist") else value)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


#: SQL name -> (feature, type).
FEATURES = {
    "image_phash": (image.phash, "string"), "image_dct_hash": (image.dct_hash, "string"), "image_fft_hash": (image.fft_hash, "string"),
    "image_average_hash": (image.average_hash, "string"), "image_difference_hash": (image.difference_hash, "string"),
    "image_hsv_histogram": (image.hsv_histogram, "array<double>"), "image_fft_features": (image.fft_features, "array<double>"),
    "image_fmt_signature": (image.fmt_signature, "array<double>"), "image_color_fmt": (image.color_fmt, "array<double>"),
    "image_hu_moments": (image.hu_moments, "array<double>"), "image_zernike": (image.zernike, "array<double>"),
    "image_color_vector": (image.color_vector, "array<double>"), "image_hog": (image.hog, "array<double>"),
}


class _Links:
    """Links of a page as rows (rank, href)."""

    def eval(self, html: str):
        import re

        for i, m in enumerate(re.finditer(r"<a\s[^>]*?href=[\"']([^\"']+)[\"']", html or "", re.I)):
            yield i + 1, m[1]


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; returns their names."""
    from pyspark.sql.functions import udtf

    for name, (f, kind) in FEATURES.items():
        spark.udf.register(name, _on_images(f, kind))
    spark.udtf.register("html_links", udtf(_Links, returnType="rank int, href string"))
    return [*FEATURES, "html_links"]
