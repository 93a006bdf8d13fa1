"""Faulty markup, nested containers and what the cut decides."""

import pytest

from chunkwise.llm import html_text
from chunkwise.llm.html_text import main_text

TEXT = "This is a paragraph of the article with quite a few words in it, so that it counts."
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{P}</article><section class='comments'><article class='comment'><p>I like this very much indeed, thanks for the text.</p></article></section>",
        f"<article>{P}</article><div><article class='comment-item'><p>I like this very much indeed, thanks for the text.</p></article></div>",
        f"<div class='sidebar'><div class='content'><p>Words of the sidebar, more of them than one would expect.</p></div></div><article>{P}</article>",
        f"<aside><article><p>Another article with a teaser of quite some words beside it.</p></article></aside><main>{P}</main>",
        f"<body><button>Go<article>{P}</article>",
        f"<body><object data=x>{P}",
        f"<article><video><p>No video for you, dear reader, get another browser.</p></video>{P}</article>",
        f"<template><article><p>A template of an article, with words in it.</p></article></template><article>{P}</article>",
        f"<svg><title>Icon</title><text>Label</text></svg><article>{P}<svg><path d='M0'/></svg></article>",
        f"<form action=x><article>{P}</article></form>",
        f"<div class='sidebar-layout'><main>{P}</main></div>",
        f"<div title='hidden gem' data-class='nav'>{P}</div>",
        f"<article><p title=\"abc>{TEXT}</article>",
        f"<article><a title=it's></a>{P}</article>",
        f"<article class='post category-related tag-comment'>{P}</article>",
        f"<article><p><b class=x onclick=\"a='>'\">{TEXT}</b></p></article>",
    ],
)
def test_markup_and_containers(page):
    assert main_text(page) == TEXT


def test_text_around_hidden_elements_and_unquoted_values():
    assert main_text("<article><p>One <a title=it's>x</a> y.</p><p>Two it's here.</p><p>Three 'quoted' text.</p></article>") == (
        "One x y. Two it's here. Three 'quoted' text."
    )
    assert main_text("<article><p>Hello <button>no</button> world</p></article>") == "Hello world"
    assert main_text("<article><p>Let <math><mi>x</mi></math> be</p></article>") == "Let x be"
    for odd in ("<button>" * 3000, "<div title=\"" * 500, "<select><option>a", "</button></p>", "<p =x a==b>t"):
        assert isinstance(main_text(odd), str)


def test_the_cut_decides(monkeypatch):
    """Short lines among paragraphs stay, a run of bare links goes; both only through the edges."""
    links = "".join(f"<li><a href=/{i}>l{i}</a></li>" for i in range(8))
    pages = [f"{P}<p>Yes.</p>{P}", f"<article>{P}<ul><li><a href=/x>link</a></li></ul>{P}</article>", f"<article>{P}<ul>{links}</ul>{P}</article>"]
    flows, whole = [], html_text._max_flow
    monkeypatch.setattr(html_text, "_max_flow", lambda *a: flows.append(1) or whole(*a))
    with_edges = [main_text(p) for p in pages]
    assert flows
    assert with_edges == [f"{TEXT} Yes. {TEXT}", f"{TEXT} link {TEXT}", f"{TEXT} {TEXT}"]
    monkeypatch.setattr(html_text, "NEIGHBOUR", 0.0)
    monkeypatch.setattr(html_text, "SIBLING", 0.0)
    assert [main_text(p) for p in pages] == [f"{TEXT} {TEXT}"] * 3
