"""Expressions over an element's tag, role, attributes and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AD_ATTRIBUTES, AD_WORDS, INTERACTIVE_WORDS, LAYOUT_WORDS, MEANINGFUL_ROLES, PROTECTED_ROLES, PROTECTED_TAGS, PROTECTED_TYPES, SEMANTIC_WORDS

#: The first rule that fits names the type. (type, tags, roles, words in the class); input rules have kinds.
TYPE_RULES = (
    ("button", ("button",), ("button",), ()),
    ("button", ("input:submit", "input:button", "input:reset"), (), ("btn", "button")),
    ("input", ("input:text", "input:email", "input:password", "input:tel", "input:url", "input:number", "textarea"), ("textbox", "searchbox"), ()),
    ("search", ("input:search",), ("search",), ("search",)),
    ("checkbox", ("input:checkbox", "input:radio"), ("checkbox", "radio", "switch"), ()),
    ("dropdown", ("select",), ("combobox", "listbox"), ()),
    ("link", ("a",), ("link",), ()),
    ("heading", ("h1", "h2", "h3", "h4", "h5", "h6"), ("heading",), ()),
    ("image", ("img", "picture", "figure"), ("img",), ()),
    ("icon", ("i", "svg"), (), ("icon",)),
    ("video", ("video", "audio"), ("video",), ()),
    ("navigation", ("nav",), ("navigation",), ("nav", "menu")),
    ("list", ("ul", "ol", "dl"), ("list", "listitem"), ()),
    ("table", ("table",), ("table", "grid"), ()),
    ("form", ("form",), ("form",), ()),
    ("card", ("article",), ("article",), ("card", "panel", "tile")),
    ("header", ("header",), ("banner",), ("page-header",)),
    ("footer", ("footer",), ("contentinfo",), ()),
    ("modal", (), ("dialog", "alertdialog"), ("modal",)),
    ("tooltip", (), ("tooltip",), ("tooltip", "popover")),
    ("menu", (), ("menu", "menubar", "menuitem"), ()),
    ("tab", (), ("tab", "tablist", "tabpanel"), ()),
    ("badge", (), (), ("badge", "label", "chip")),
)


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def attribute(attrs: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))


def has_word(c: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)) if words else F.lit(False)


def guess_type(tag: Column, role: Column, attrs: Column) -> Column:
    """The element's type by the ordered rules, then ads, logos and text blocks, else its tag or unknown."""
    tag, role = F.trim(_text(tag)), F.trim(_text(role))
    attrs = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    classes, kind = F.lower(attribute(attrs, "class")), F.lower(attribute(attrs, "type"))
    out = None
    for name, tags, roles, words in TYPE_RULES:
        plain, kinds = [t for t in tags if ":" not in t], [t.split(":")[1] for t in tags if ":" in t]
        fits = tag.isin(plain) | ((tag == "input") & kind.isin(kinds)) | role.isin(*roles) if roles else tag.isin(plain) | ((tag == "input") & kind.isin(kinds))
        fits = fits | has_word(classes, words)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    ad = classes.rlike(f"(?i){AD_WORDS}") | attribute(attrs, "id").rlike(f"(?i){AD_WORDS}") | F.arrays_overlap(F.map_keys(attrs), F.array(*map(F.lit, AD_ATTRIBUTES)))
    out = out.when(ad, "ad").when(F.contains(classes, F.lit("logo")), "logo")
    out = out.when(tag.isin("p", "span", "div", "section", "main") & role.isin("", "text"), "text")
    return out.when(tag != "", tag).otherwise("unknown")


def is_protected(tag: Column, role: Column, type_: Column, classes: Column, onclick: Column) -> Column:
    held = F.contains(_text(classes), F.lit("clickable")) | F.contains(_text(classes), F.lit("interactive"))
    return _text(type_).isin(*PROTECTED_TYPES) | _text(role).isin(*PROTECTED_ROLES) | _text(tag).isin(*PROTECTED_TAGS) | (_text(onclick) != "") | held


def is_interactive(attrs: Column) -> Column:
    """An ``on...`` attribute, a telling word in class or id, or a pointer cursor."""
    attrs = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    classes, own, style = (F.lower(attribute(attrs, a)) for a in ("class", "id", "style"))
    return F.exists(F.map_keys(attrs), lambda k: F.startswith(k, F.lit("on"))) | has_word(classes, INTERACTIVE_WORDS) | has_word(own, INTERACTIVE_WORDS) | (F.contains(style, F.lit("cursor")) & F.contains(style, F.lit("pointer")))


def is_layout_shell(tag: Column, type_: Column, attrs: Column, text: Column) -> Column:
    """A div or span of type div or container with layout words, no telling ones, and no text."""
    classes, own = F.lower(attribute(attrs, "class")), F.lower(attribute(attrs, "id"))
    return _text(type_).isin("div", "container") & _text(tag).isin("div", "span") & has_word(classes, LAYOUT_WORDS) & ~has_word(classes, SEMANTIC_WORDS) & ~has_word(own, SEMANTIC_WORDS) & (F.trim(F.coalesce(text, F.lit(""))) == "")


def is_wrapper(tag: Column, role: Column, type_: Column, attrs: Column, children: Column) -> Column:
    """A div of type text without a meaningful role or sign of interaction that has a child."""
    return (_text(tag) == "div") & (_text(type_) == "text") & ~_text(role).isin(*MEANINGFUL_ROLES) & ~is_interactive(attrs) & (children >= 1)


def element_class(label: Column, type_: Column) -> Column:
    """The label unless blank or unknown, else the type unless blank or unknown, else null."""
    known = lambda c: F.when(~F.lower(F.trim(c)).isin("", "unknown"), F.trim(c))
    return F.coalesce(known(label), known(type_))
