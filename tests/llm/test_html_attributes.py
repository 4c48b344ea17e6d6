"""Attributes of pages are told apart from what stands in their values."""

import pytest

from lumenlog.llm.html import _names, blocks


@pytest.mark.parametrize("attributes", ['href="/hidden-gems"', 'title="hidden costs"', 'aria-hidden="false"', "title='style=display:none'", "data-hidden=1"])
def test_values_and_longer_names_hide_nothing(attributes):
    assert [b.text() for b in blocks(f"<div><p {attributes}>Kept text.</p></div>")] == ["Kept text."]


@pytest.mark.parametrize("attributes", ["hidden", 'class="a"hidden', "HIDDEN=''", 'id=x hidden="until-found"', 'style="display: none"', "style='color:red;display:none'"])
def test_hidden_elements_stay_hidden(attributes):
    assert blocks(f"<div><p {attributes}>Lost text.</p></div>") == []


def test_names():
    assert _names(' class="mainText side" data-id="nav" id=foot title="class=advert"') == (("main", "text", "side", "foot"), False, None)
    assert _names(" data-label='main' role=menu") == (("menu",), False, "main")
