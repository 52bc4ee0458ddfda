"""Vocabularies and schemas of the screen dataset."""

from __future__ import annotations

from pyspark.sql import types as T

# The order of CLASSES is the class id; the other lists are memberships.
CLASSES = (
    "Table", "Column/Browser", "Button", "Utility Button", "App Icon", "Navigation Bar", "Status Bar", "Search Field",
    "Toolbar", "Tooltip", "Video", "Tab Bar", "Side Bar", "Slider", "Picker", "ContextMenu", "DockMenu", "EditMenu",
    "Image", "Scroll", "Switch", "File Icon", "Chart", "Window", "Screen", "List", "List Item", "PopUp Menu", "Steppers",
    "Toggles", "Text Input", "Rating Indicator", "Checkbox", "Radiobox", "Select", "Avatar", "Badge", "Alert",
    "Progress bar", "Bottom navigation", "Breadcrumb", "Page control", "Link", "Menu", "Pagination", "Tab", "Search Bar",
    "Date-Time picker", "Calendar", "Text", "Heading", "Code snippet", "Carousel", "Notification", "Logo",
)
CONTAINERS = (
    "Table", "Column/Browser", "Navigation Bar", "Status Bar", "Toolbar", "Tab Bar", "Side Bar", "ContextMenu", "DockMenu",
    "EditMenu", "Scroll", "Window", "Screen", "List", "PopUp Menu", "Alert", "Bottom navigation", "Breadcrumb", "Menu",
    "Pagination", "Search Bar", "Date-Time picker", "Calendar", "Carousel", "Notification",
)
ATOMIC = tuple(c for c in CLASSES if c not in CONTAINERS)
NON_NESTABLE = (
    "Text", "Heading", "Link", "Button", "Utility Button", "App Icon", "File Icon", "Image", "Logo", "Checkbox",
    "Radiobox", "Switch", "Slider", "Text Input", "Search Field", "Date-Time picker", "Progress bar", "Rating Indicator",
    "Avatar", "Badge",
)
LEAF_ONLY = ("Text", "Heading", "Image", "Logo", "Avatar", "Badge", "Checkbox", "Radiobox", "Switch", "Slider", "Progress bar", "Rating Indicator")
LABEL_ALIASES = {
    "progressbar": "Progress bar", "progress-bar": "Progress bar", "navbar": "Navigation Bar", "sidebar": "Side Bar",
    "bottom nav": "Bottom navigation", "breadcrumb": "Breadcrumb", "pathcontrol": "Breadcrumb", "pagecontrol": "Page control",
    "check box": "Checkbox", "checkbox button": "Checkbox", "radio": "Radiobox", "radio button": "Radiobox",
    "radiobutton": "Radiobox", "text field": "Text Input", "input": "Text Input", "search box": "Search Field",
    "search input": "Search Field", "searchbar": "Search Bar", "avatar image": "Avatar", "profile image": "Avatar",
    "user image": "Avatar", "icon": "File Icon", "logo image": "Logo", "video player": "Video", "image view": "Image",
    "picture": "Image",
}
#: Ordered (keyword, class) of the fallback from an element's type.
TYPE_KEYWORDS = (
    ("button", "Button"), ("btn", "Button"), ("input", "Text Input"), ("field", "Text Input"), ("search", "Search Field"),
    ("checkbox", "Checkbox"), ("radio", "Radiobox"), ("table", "Table"), ("list", "List"), ("tab", "Tab"), ("menu", "Menu"),
    ("nav", "Navigation Bar"), ("image", "Image"), ("img", "Image"), ("picture", "Image"), ("text", "Text"),
    ("paragraph", "Text"), ("label", "Text"), ("logo", "Logo"), ("brand", "Logo"), ("tooltip", "Tooltip"), ("badge", "Badge"),
    ("chip", "Badge"), ("video", "Video"), ("slider", "Slider"), ("calendar", "Calendar"),
)
EIGHT = ("Input Element", "Sidebar", "Information Display", "Button", "Navigation", "Visual Elements", "Menu", "Others")
EIGHT_OF = {
    "Input Element": ("Search Field", "Slider", "Picker", "Switch", "Steppers", "Toggles", "Text Input", "Rating Indicator", "Checkbox", "Radiobox", "Select", "Search Bar", "Date-Time picker", "Calendar"),
    "Sidebar": ("Side Bar", "Toolbar", "Column/Browser"),
    "Information Display": ("Table", "Status Bar", "Tooltip", "List", "List Item", "Alert", "Text", "Heading", "Code snippet", "Notification"),
    "Button": ("Button", "Utility Button"),
    "Navigation": ("Navigation Bar", "Tab Bar", "Scroll", "Bottom navigation", "Breadcrumb", "Page control", "Link", "Pagination", "Tab"),
    "Visual Elements": ("App Icon", "Video", "Image", "File Icon", "Chart", "Avatar", "Badge", "Progress bar", "Carousel", "Logo"),
    "Menu": ("ContextMenu", "DockMenu", "EditMenu", "PopUp Menu", "Menu"),
    "Others": ("Window", "Screen"),
}
EIGHT_REPRESENTATIVE = {"Input Element": "Text Input", "Sidebar": "Side Bar", "Information Display": "Text", "Button": "Button", "Navigation": "Navigation Bar", "Visual Elements": "Image", "Menu": "Menu", "Others": "Link"}
TWO = ("icon", "text")
TWO_TEXT = ("Table", "Status Bar", "Tooltip", "List", "List Item", "Alert", "Text", "Heading", "Code snippet", "Notification", "Badge", "Breadcrumb", "Link", "Pagination")
TWO_REPRESENTATIVE = {"text": "Text", "icon": "Image"}
OCR_LABELS = {"text": "Text", "image": "Image", "header_image": "Image", "footer_image": "Image", "paragraph_title": "Heading", "header": "Heading", "aside_text": "Text", "footer": "Text", "footnote": "Text"}
PROTECTED_TYPES = (
    "button", "utility button", "slider", "picker", "switch", "toggles", "steppers", "checkbox", "radiobox", "select",
    "text input", "search field", "search bar", "date-time picker", "rating indicator", "input", "textarea", "radio",
    "navigation bar", "tab bar", "tab", "side bar", "breadcrumb", "bottom navigation", "page control", "pagination", "link",
    "menu", "contextmenu", "dockmenu", "editmenu", "popup menu", "toolbar", "image", "video", "audio", "chart", "table",
    "list", "list item", "list_item", "avatar", "logo", "code snippet", "carousel", "calendar", "heading", "title", "tooltip",
    "alert", "notification", "badge", "progress bar", "app icon", "file icon", "icon", "svg", "card", "modal", "chip", "form",
    "scroll", "status bar", "window",
)
PROTECTED_ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "navigation", "menu", "menuitem")
PROTECTED_TAGS = ("button", "input", "a", "select", "textarea", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt")
INTERACTIVE_WORDS = ("btn", "button", "link", "click", "interactive", "action", "menu", "nav", "control", "input", "field", "form", "tab", "toggle", "switch", "select", "dropdown")
LAYOUT_WORDS = ("container", "wrapper", "row", "col", "grid", "flex", "layout", "inner", "outer", "content-wrap")
SEMANTIC_WORDS = ("card", "panel", "box", "item", "block", "section", "header", "footer", "nav", "menu", "sidebar", "btn", "button", "link", "modal", "popup")
MEANINGFUL_ROLES = ("button", "link", "navigation", "banner", "contentinfo", "main", "search", "region", "complementary", "form", "alert", "dialog", "menu", "menubar", "tab", "tablist", "tabpanel", "listbox", "combobox")
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote")
AD_FRAME_HOSTS = ("doubleclick.net", "googlesyndication.com", "googleadservices.com", "adnxs.com", "amazon-adsystem.com", "taboola.com", "outbrain.com", "criteo.com", "pubmatic.com", "openx.net", "rubiconproject.com", "moatads.com", "adsrvr.org", "facebook.com/tr")
TRACKING_FRAME_HOSTS = ("google-analytics.com", "googletagmanager.com", "hotjar.com", "segment.com", "mixpanel.com")
AD_WORDS = r"\b(ad|ads|advert|advertisement|adunit|ad-unit|ad_unit|sponsor|sponsored|promo|dfp|gpt-ad|doubleclick|adsense|adsbygoogle|ad-slot|ad-container|banner-ad)\b"
AD_ATTRIBUTES = ("data-ad", "data-ad-slot", "data-adunit", "data-ad-client", "data-google-query-id", "data-ad-format", "data-adsbygoogle-status")

#: Viewport, filter and score defaults.
VIEWPORT_W, VIEWPORT_H = 1440, 900
MAX_AREA = VIEWPORT_W * VIEWPORT_H // 2
IOU, CONTAINMENT, MIN_AREA, QUALITY = 0.95, 0.98, 4, 70.0

RECT = T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"])
ELEMENT = T.StructType([
    T.StructField("screen_id", T.StringType()), T.StructField("elem_idx", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("id", T.StringType()), T.StructField("classes", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("rect", RECT), T.StructField("z", T.DoubleType()),
    T.StructField("position", T.StringType()), T.StructField("aria_hidden", T.StringType()), T.StructField("inner_text", T.StringType()),
    T.StructField("_dom_index", T.IntegerType()), T.StructField("_parent_dom_index", T.IntegerType()),
    T.StructField("_children_dom_indices", T.ArrayType(T.IntegerType())), T.StructField("_depth", T.IntegerType()),
    T.StructField("frame_index", T.IntegerType()), T.StructField("type", T.StringType()),
])
NODES = "node_id int, parent_id int, depth int, tag string, l int, t int, r int, b int, text string"
