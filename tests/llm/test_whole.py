"""Texts and headers that are read whole."""

from codeloom.llm import handwritten, leakage


def leaks(text, items):
    n = leakage.Numbers()
    return [i for i, t in items if leakage.held(leakage.Item(n.of(t)), leakage.Doc(n.of(text))) >= leakage.SHARE]


def test_pair_beside_many_repeated_quotations():
    item = [f"i{k}" for k in range(60)]
    text = " ".join([*item[:16], *["x"] * 12, *item[45:], *(["y"] * 12 + item[:29]) * 6])
    # only the first two stretches, with 31 of 60 words in order, reach the half
    items = [(1, " ".join(item))]
    assert leaks(text, items) == [1]
    text = " ".join([*item[40:58], *["x"] * 12, *(item[14:43] + ["x"] * 12) * 6, *item[:12]])
    assert leaks(text, items) == []


def test_short_items_leak():
    fill = ["plain", "words", "of", "a", "page"] * 9
    items = [(5, "kob zan tir mel dov"), (2, "Lun Par"), (1, "Qix"), (0, "--"), (9, " ".join(f"i{k}" for k in range(16)))]
    one = lambda *w: sorted(leaks(" ".join([*fill, *w, *fill]), items))
    assert one("kob", "zan", "tir", "mel", "dov") == [5] == one("zan", "tir", "mel")
    assert one("lun", "par!") == [2] and one("QIX") == [1] and one() == [] == one("kob", "zan") == one("par", "lun")
    assert one("i0", "i1", "i2", "i3", *fill, "i11", "i12", "i13", "i14") == [9]
    assert one("i11", "i12", "i13", "i14", *fill, "i0", "i1", "i2", "i3") == []


def test_marks_after_a_long_banner():
    banner = "// A banner that says nothing of who wrote the file.\n" * 60
    for mark, verdict in (("// Code generated by tool v1. DO NOT EDIT.", "generated"), ("// Copyright (c) other contributors. SPDX-License-Identifier: MIT", "third_party")):
        head = handwritten.layout(banner + mark + "\n\nfunc run() {\n}\n").comments
        assert len(head) > 2000 and handwritten.header_verdict(head, "harbor") == verdict
    assert handwritten.header_verdict(banner, "harbor") == ""
