from millrace.llm.survivor import _copying


def test_all_shared_claims_count():
    """Of the same mixture of claims, with a mean log ratio of about 0.006, a hundred thousand tell what a hundred cannot."""
    few, many = ({("a", "b"): [93 * n, n, 6 * n]} for n in (1, 1000))
    accuracy = {"a": 0.94, "b": 0.94}
    assert _copying(few, accuracy)["a", "b"] < 0.5
    assert _copying(many, accuracy)["a", "b"] > 0.99
