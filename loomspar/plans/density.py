"""Kernel density queries over event values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators.density import binned_density, modes
from loomspar.session import table


def kde_modes(spark, d):
    return modes(binned_density(table(spark, d, "events"), "event_type", "value", 0.0, 400.0, 200, 5.0), "event_type")


def angle_densities(spark, d):
    """Densities of values read as angles, by a von Mises kernel."""
    e = table(spark, d, "events").withColumn("a", F.pmod("value", F.lit(6.28318530717958)))
    return binned_density(e, "event_type", "a", 0.0, 6.28318530717959, 36, 20.0, "von_mises").select("event_type", "bin", F.round("density", 9).alias("density"))


QUERIES = {f.__name__: f for f in (kde_modes, angle_densities)}
SQL = {
    "kde_modes": """WITH c AS (SELECT event_type, floor(value / 2.0) AS b, count(*) AS n FROM events WHERE value >= 0 AND value < 400 GROUP BY ALL), t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) > 50),
  d AS (SELECT c.event_type, (g + 0.5) * 2.0 AS x, round(sum(n * exp(-((((g - b) * 2.0) / 5.0) ** 2) / 2)) / (any_value(total) * 5.0 * sqrt(2 * pi())), 9) AS density FROM c JOIN t ON t.event_type = c.event_type CROSS JOIN range(200) r(g) GROUP BY c.event_type, g)
  SELECT event_type, CAST(x AS DOUBLE) AS mode, density AS max_density FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY density DESC, x) = 1"""
}
