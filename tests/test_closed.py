from weftline.functions.replies import closed


def test_closed_takes_the_longest_beginning():
    assert closed('{"a": 1} ' + "word " * 40) == '{"a": 1}'
    assert closed('{"a": [1, 2], ?? ' + "x1 " * 60) == '{"a": [1, 2]}'
    assert closed('{"a": "b", "c": [1, 2') == '{"a": "b", "c": [1, 2]}' and closed('{"a": "b') == '{"a": "b"}'
    assert closed('{"a": 1, "b"') == '{"a": 1}' and closed('[1, tru') == "[1]" and closed("") is None and closed("no") is None
