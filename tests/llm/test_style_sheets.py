import time

import pytest

from ripplegraph.llm.html_text import visible_text
from ripplegraph.llm.style_sheets import Styles, media_holds, rules

SHOWN = {
    "@media print{.x{display:none}}": True,
    "@media screen{.x{display:none}}": False,
    "@media (max-width:600px){.x{display:none}}": True,
    "@media (min-width:600px){.x{display:none}}": False,
    "@media (min-width:600px) and (max-width:40em){.x{display:none}}": True,
    "@media print, (width >= 37.5rem){.x{display:none}}": False,
    "@media (600px <= width < 2000px){.x{display:none}}": False,
    "@media not print{.x{display:none}}": False,
    "@media not all and (min-width:1px){.x{display:none}}": True,
    "@media not screen and (min-width:5000px){.x{display:none}}": False,
    "@media (prefers-color-scheme:dark){.x{display:none}}": True,
    "@media (orientation:landscape){.x{display:none}}": False,
    "@media (unknown-thing){.x{display:none}}": True,
    "@media screen{@media print{.x{display:none}}}": True,
    "@media print{@media screen{.x{display:none}}}": True,
    "@media print{.y{color:red}}.x{display:none}": False,
    "@supports (display:grid){.x{display:none}}": False,
    "@supports not (display:grid){.x{display:none}}": True,
    "@keyframes k{from{display:none}to{display:none}} .x{color:red}": True,
    "@font-face{font-family:x;display:none}": True,
    "@import 'a.css';.x{display:none}": False,
    "@charset \"utf-8\";\n.x{display:none}": False,
    ".x{display:none}.x{display:block}": True,
    ".x{display:block}.x{display:none}": False,
    ".x{display:none;display:block}": True,
    ".x{display:none!important}.x{display:block}": False,
    ".x{display:none}p{display:block}": False,
    "p{display:none}.x{display:block}": True,
    "p.x{display:none}.x{display:block}": False,
    ".x.y{display:none}": True,
    "#i{display:block}.x{display:none}": True,
    "*{display:none}.x{display:block}body,html{display:block}": True,
    ".a .x{display:none}": True,
    ".x:hover{display:none}": True,
    "/* .x{display:none} */": True,
    "/* } */.x{/* ; */display/* : */:none}": False,
    ".y::before{content:'}.x{display:none}'}": True,
    ".y{background:url(\"a;b}c\")}.x{display:none}": False,
    ".x{color:red;.z{display:none;}}": True,
    ".x{display:none": False,
    "@media screen{.x{display:none": False,
    "<!-- .x{display:none} -->": False,
    "}} .x{display:none}": True,
    ".x{visibility:hidden}": False,
    ".x{visibility:hidden}.x{visibility:visible}": True,
    "@media print{.x{visibility:hidden}}": True,
}


@pytest.mark.parametrize("sheet", SHOWN)
def test_shown_or_not(sheet):
    assert visible_text(f"<style>{sheet}</style><p class=x id=i>shown</p>") == ("shown" if SHOWN[sheet] else "")


@pytest.mark.parametrize(
    ("html", "text"),
    {
        "<style>.x{display:block}</style><p class=x style='display:none'>a</p>b": "b",
        "<style>.x{display:block!important}</style><p class=x style='display:none'>a</p>b": "a\n\nb",
        "<style>[hidden]{display:none}.x{display:block}</style><p class=x hidden>a</p><p hidden>no</p>b": "a\n\nb",
        "<style media=print>.x{display:none}</style><p class=x>a</p>": "a",
        "<style media='screen'>.x{display:none}</style><p class=x>a</p>b": "b",
        "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
        "<style>dialog{display:block}</style><dialog>yes</dialog>": "yes",
        "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
        "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
        "<ol reversed start=9><li>a<li value=4>b<li>c</ol>": "9. a\n4. b\n3. c",
        "<p style='/*display:none*/color:red'>a</p>": "a",
        "<style>.n{visibility:hidden}</style><div class=n>no <b style='visibility:visible'>yes</b></div>": "yes",
    }.items(),
)
def test_with_attributes(html, text):
    assert visible_text(html) == text


def test_rules_in_order():
    assert [(a.strip(), [x for x in b if x]) for a, b in rules("a{b:c;d:e}@media print{f{g:h}}i , j{k:l}")] == [("a", ["b:c", "d:e"]), ("i , j", ["k:l"])]
    assert media_holds("") and media_holds("ALL") and not media_holds("tv, speech")


def test_time_in_proportion_to_the_sheet():
    for part in ("a{b:c}", "@media screen{", "{", "}", "'", "/*", "a,", "(", "a{", ";", "not "):
        began = time.time()
        Styles([part * 20_000])
        media_holds(part * 20_000)
        assert time.time() - began < 3, part
