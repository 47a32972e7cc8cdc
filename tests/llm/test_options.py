"""Choices without end tags take nothing of the page with them."""

from quillspark.llm import html_extract as H


def text_of(page, kinds=(H.MAIN,)):
    return "\n".join(t for t, k in H.blocks(page) if k in kinds)


def test_options_without_end_tags():
    assert text_of('<form><datalist><option value="a"></datalist></form><article>text</article>') == "text"
    assert text_of("<datalist><option>a<option>b</datalist><article>x</article><select><option>c</option></select><article>y</article>") == "x\ny"
    assert text_of("<datalist><optgroup><option>a<optgroup><option>b</datalist><article>x</article>") == "x"
    assert text_of("<option>a<article>x</article>") == "x" and text_of("<article>x<datalist><option>a</datalist>y</article>") == "x\ny"
    assert text_of("<div>x</div><datalist><option>a</datalist><div>y</div>", (H.MAIN, H.OPEN)) == "x\ny"
