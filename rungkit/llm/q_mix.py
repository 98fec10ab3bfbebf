"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.llm.common import query, read
from rungkit.llm.mixing import copies, fit_rates

#: the mixture's shares are the sources' shares of tokens to this power
EXPONENT = 0.7


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    rates, _ = fit_rates(read(spark, sf_dir, "documents"), "doc_id", "text", "source", exponent=EXPONENT)
    return rates.select("doc_id", "domain", "tokens", "rate",
                        copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias("copies"))
