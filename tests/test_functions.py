"""Scalar and statistical functions against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from lethe.functions import stats, text
from pyspark.sql import functions as F


def test_t_tail_closed_form_with_four_degrees():
    t = np.linspace(-6, 6, 49)
    u = t / np.sqrt(1 + t * t / 4)
    closed = 0.5 - 0.375 * u * (1 - t * t / (12 * (1 + t * t / 4)))
    assert np.allclose(stats.t_tail(t, np.full_like(t, 4.0)), closed, atol=1e-13)


def test_t_tail_far_out_and_critical():
    assert 5e-17 < stats.t_tail(np.array([26.2]), np.array([19.0]))[0] < 2e-16
    assert stats.t_tail(np.array([0.29]), np.array([19.0]))[0] == pytest.approx(0.389, abs=5e-3)
    assert stats.t_critical(0.05, 4) == pytest.approx(2.131846786, abs=1e-8)
    assert np.isnan(stats.t_tail(np.array([np.nan]), np.array([4.0]))[0])
    assert stats.t_tail(np.array([np.inf, -np.inf]), np.array([4.0, 4.0])).tolist() == [0.0, 1.0]


def test_exact_upper_bound():
    assert stats.exact_upper([0], [20], 0.05)[0] == pytest.approx(1 - 0.05 ** (1 / 20))
    assert stats.exact_upper([20], [20], 0.05)[0] == 1.0
    p = stats.exact_upper([3], [20], 0.05)[0]
    assert sum(math.comb(20, j) * p**j * (1 - p) ** (20 - j) for j in range(4)) == pytest.approx(0.05, abs=1e-9)
    assert np.isnan(stats.exact_upper([1], [0], 0.05)[0])


def test_sample_sd_and_interval(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.1), ("b", 1.0), ("c", 1.0), ("c", 3.0)], "k string, v double")
    sd = {r.k: r.s for r in rows.groupBy("k").agg(stats.sample_sd(F.col("v")).alias("s")).collect()}
    assert sd == {"a": 0.0, "b": 0.0, "c": pytest.approx(math.sqrt(2))}
    low, high = spark.range(101).agg(stats.interval(F.col("id").cast("double"), 0.1).alias("i")).first().i
    assert (low, high) == (5.0, 95.0)


def test_text_functions(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    s = F.lit
    assert row(text.slugify(s("Straße & Co."), s(" X1 ")))[0] == "strasse_co_x1"
    assert row(text.slugify(s("--")))[0] is None
    assert row(text.normalise(s("  A\n\tB  ")))[0] == "a b"
    assert row(text.span_status(s("abcabc"), s("bc"), s(1), s(3)))[0] == "exact"
    assert row(text.span_status(s("abcabc"), s("bc"), s(0), s(2)))[0] == "repaired"
    assert row(text.span_status(s("abc"), s("x"), s(0), s(1)))[0] == "span_unresolved"
    assert row(text.rouge_l(s("a c"), s("a b c")))[0] == pytest.approx(0.8)
    assert row(text.rouge_l(s(""), s("a")))[0] == 0.0
