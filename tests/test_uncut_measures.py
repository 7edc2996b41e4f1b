"""Measures of pages count every form field and call to action; only the printed summaries are cut."""

from funnelscope.operators import features, layers

LONG = "<form>" + "".join(f'<input name="company {i}" required>' for i in range(20)) + "</form>"
HTML = ("<html><body>" + "".join(f'<a href="/p{i}">Book a demo {i}</a>' for i in range(40)) + "<button>BOOK A DEMO 0</button>" + LONG
        + '<form><input name="email, phone" required><input type="hidden" name="t"></form>'
        + "".join(f'<form><input id="bank{i}"></form>' for i in range(5)) + "</body></html>")


def page(spark):
    row = ("https://a.example/signup", "standard", 200, "text/html", "https://a.example/signup", HTML, None)
    schema = "url string, mode string, status_code int, content_type string, final_url string, html string, error string"
    return features.page_features(spark.createDataFrame([row], schema))


def test_calls_to_action(spark):
    row = layers.primary_competing_ctas(page(spark)).first()
    assert (row["primary_cta"], row["n_competing"]) == ("Book a demo 0", 39)
    assert row["competing_ctas"] == [f"Book a demo {i}" for i in range(1, 40)]
    assert page(spark).first()["ctas"] == [f"Book a demo {i} -> https://a.example/p{i}" for i in range(25)]


def test_form_fields(spark):
    row = layers.friction_signals(page(spark)).first()
    assert (row["visible_fields"], row["required_fields"]) == (26, 21)
    assert len(page(spark).first()["forms"]) == 5


def test_fields_by_category(spark):
    row = layers.upfront_information(page(spark)).first().asDict()
    assert {k: v for k, v in row.items() if v} == {
        "url": "https://a.example/signup", "bank": 5, "contact": 1, "identity": 20, "required_contact": 1, "required_identity": 20,
        "required": 21, "is_signup": True}
