"""Scalar functions at their edges."""

from pyspark.sql import functions as F

from lodestream.functions import scalars as X


def first(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_references_without_a_semicolon_stay_where_only_closed_ones_count(spark):
    """An entity cut off by a tag: parsers resolve it, the SQL of x8_stripped_html does not."""
    html = "<p>a&amp</p> b&amp; &lt;c&gt; &amp;amp; &#39;&copy d&notit; &&&amp e"
    assert first(spark, X.stripped_html, html) == "a& b& <c> &amp; '© d¬it; &&& e"
    assert first(spark, lambda t: X.stripped_html(t, closed=True), html) == "a&amp b& <c> &amp; '&copy d¬it; &&&amp e"


def test_previews_keep_references_without_a_semicolon_where_only_closed_ones_count(spark):
    text = "# T\n[docs](http://d) x&amp<br>y &quot;z&quot;"
    assert first(spark, X.preview, text) == 'T docs x& y "z"'
    assert first(spark, lambda t: X.preview(t, closed=True), text) == 'T docs x&amp y "z"'
