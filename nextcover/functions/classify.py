"""Product classification as ordered rule tables.

A rule is a label with alternatives; the first rule with a matching alternative wins.
An alternative is ``(field, kind, values)`` with kind ``in`` or ``like``, or a tuple
``("all", alternative, alternative)`` that needs both. Fields are ``lob``, ``level1``,
``level2`` and ``product``; matching is case sensitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import flag

# ---- fixed values: categories, codes and patterns that results depend on ----
CATEGORIES = [
    "LIFE_INSURANCE", "RETIREMENT", "INVESTMENT", "NETWORK_PRODUCTS",
    "DISABILITY", "HEALTH", "OTHER",
]
TARGET_CATEGORIES = CATEGORIES[:-1]
LIFE_CODES = ["VLI", "WL", "UL/IUL", "TERM", "PROTECTIVE PRODUCT"]
RETIREMENT_LOBS = ["GROUP RETIREMENT", "INDIVIDUAL RETIREMENT"]
RETIREMENT_CODES = ["EQUIVEST", "RETIREMENT 401K", "ACCUMULATOR", "RETIREMENT CORNERSTONE", "SCS"]
INVESTMENT_CODES = [
    "INVESTMENT PRODUCT - DIRECT", "INVESTMENT PRODUCT - BROKERAGE",
    "INVESTMENT PRODUCT - ADVISORY", "DIRECT", "BROKERAGE", "ADVISORY",
]

CATEGORY_RULES = [
    ("LIFE_INSURANCE",
     ("lob", "in", ["LIFE"]),
     ("level1", "in", LIFE_CODES),
     ("level2", "like", ["%LIFE%"]),
     ("level2", "in", ["TERM PRODUCT", "MONY PROTECTIVE PRODUCT"])),
    ("RETIREMENT",
     ("lob", "in", RETIREMENT_LOBS),
     ("level1", "in", RETIREMENT_CODES + ["INVESTMENT EDGE"]),
     ("level2", "like", ["%403B%", "%401%", "%IRA%", "%SEP%"]),
     ("product", "like", ["%IRA%", "%401%", "%403%", "%SEP%", "%Accumulator%", "%Retirement%"])),
    ("INVESTMENT",
     ("lob", "in", ["BROKER DEALER"]),
     ("level1", "in", INVESTMENT_CODES + ["CASH SOLICITOR"]),
     ("level2", "like", ["%Investment%", "%Brokerage%", "%Advisory%"])),
    ("NETWORK_PRODUCTS",
     ("lob", "in", ["NETWORK"]),
     ("level1", "in", ["NETWORK PRODUCTS"]),
     ("level2", "in", ["NETWORK PRODUCTS"]),
     ("product", "like", ["%Network%"])),
    ("DISABILITY",
     ("all", ("lob", "in", ["OTHERS"]), ("level1", "in", ["HAS"])),
     ("level2", "in", ["HAS - DISABILITY"]),
     ("product", "like", ["%Disability%", "%DI -%"])),
    ("HEALTH",
     ("lob", "in", ["OTHERS"]),
     ("level2", "in", ["GROUP HEALTH PRODUCTS"]),
     ("product", "like", ["%Health%", "%Medical%", "%Hospital%"])),
]

RETIREMENT_GATE = [("lob", "in", RETIREMENT_LOBS), ("level1", "in", RETIREMENT_CODES)]
RETIREMENT_SUB_RULES = [
    ("RETIREMENT_403B", ("level2", "like", ["%403B%"]), ("product", "like", ["%403%"])),
    ("RETIREMENT_401K", ("level2", "like", ["%401%"]), ("product", "like", ["%401%"])),
    ("RETIREMENT_ROTH_IRA", ("level2", "like", ["%Roth%"]), ("product", "like", ["%Roth%"])),
    ("RETIREMENT_TRADITIONAL_IRA", ("level2", "like", ["%Traditional IRA%"]),
     ("product", "like", ["%Traditional IRA%"])),
    ("RETIREMENT_SEP", ("level2", "like", ["%SEP%"]), ("product", "like", ["%SEP%"])),
    ("RETIREMENT_ROLLOVER_IRA", ("level2", "like", ["%Rollover%"]), ("product", "like", ["%Rollover%"])),
    ("RETIREMENT_IRA", ("product", "like", ["%IRA%"])),
    ("RETIREMENT_ANNUITY", ("level1", "in", ["ACCUMULATOR"])),
]

LIFE_GATE = [("lob", "in", ["LIFE"]), ("level1", "in", LIFE_CODES)]
LIFE_SUB_RULES = [
    ("LIFE_TERM", ("level1", "in", ["TERM"]), ("level2", "in", ["TERM PRODUCT"]),
     ("product", "like", ["%Term%"])),
    ("LIFE_WHOLE", ("level1", "in", ["WL"]), ("level2", "like", ["%WHOLE LIFE%"]),
     ("product", "like", ["%Whole Life%"])),
    ("LIFE_VARIABLE_UNIVERSAL", ("level1", "in", ["VLI"]), ("level2", "like", ["%VARIABLE%"]),
     ("product", "like", ["%Variable%"])),
    ("LIFE_INDEXED_UNIVERSAL",
     ("all", ("level1", "in", ["UL/IUL"]), ("level2", "like", ["%INDEX%"])),
     ("product", "like", ["%Indexed%"])),
    ("LIFE_UNIVERSAL", ("level1", "in", ["UL/IUL"]), ("level2", "like", ["%UNIVERSAL%"]),
     ("product", "like", ["%Universal%"])),
]

INVESTMENT_GATE = [("lob", "in", ["BROKER DEALER"]), ("level1", "in", INVESTMENT_CODES)]
INVESTMENT_SUB_RULES = [
    ("INVESTMENT_ADVISORY", ("level1", "like", ["%ADVISORY%"]),
     ("product", "like", ["%Advisory%", "%MWP%", "%SAM%"])),
    ("INVESTMENT_BROKERAGE", ("level1", "like", ["%BROKERAGE%"]), ("product", "like", ["%Brokerage%"])),
    ("INVESTMENT_DIRECT", ("level1", "like", ["%DIRECT%"]), ("product", "like", ["%Direct%"])),
]

TAX_RULES = [
    ("TAX_FREE", ("level2", "like", ["%Roth%"]), ("product", "like", ["%Roth%"])),
    ("TAX_DEFERRED", ("level2", "like", ["%Traditional%"]), ("product", "like", ["%Traditional%"])),
    ("NON_QUALIFIED", ("level2", "like", ["%Non%Qualified%", "%NQ%"]),
     ("product", "like", ["%Non Qualified%", "%(NQ)%"])),
    ("TAX_ADVANTAGED", ("lob", "in", RETIREMENT_LOBS)),
]
INVESTMENT_TYPE_RULES = [
    ("VARIABLE", ("level2", "like", ["%VARIABLE%"]), ("product", "like", ["%Variable%"])),
    ("INDEXED", ("level2", "like", ["%INDEX%"]), ("product", "like", ["%Index%"])),
    ("FIXED", ("level2", "like", ["%Fixed%"]), ("product", "like", ["%Fixed%"])),
]
ACCOUNT_TYPE_RULES = [
    ("RETIREMENT_ACCOUNT", ("level2", "like", ["%Retirement%"]), ("product", "like", ["%Retirement%"]),
     ("lob", "in", RETIREMENT_LOBS)),
    ("NON_RETIREMENT_ACCOUNT", ("level2", "like", ["%Non-Retirement%"]),
     ("product", "like", ["%Non-Retirement%"])),
]

# flag name -> (column, kind, value)
SUB_TARGETS = {
    "retirement_401k_cross_sell": ("cross_sell_retirement_sub", "in", "RETIREMENT_401K"),
    "retirement_403b_cross_sell": ("cross_sell_retirement_sub", "in", "RETIREMENT_403B"),
    "retirement_ira_cross_sell": ("cross_sell_retirement_sub", "like", "%IRA%"),
    "retirement_roth_cross_sell": ("cross_sell_retirement_sub", "in", "RETIREMENT_ROTH_IRA"),
    "retirement_annuity_cross_sell": ("cross_sell_retirement_sub", "in", "RETIREMENT_ANNUITY"),
    "life_term_cross_sell": ("cross_sell_life_sub", "in", "LIFE_TERM"),
    "life_whole_cross_sell": ("cross_sell_life_sub", "in", "LIFE_WHOLE"),
    "life_universal_cross_sell": ("cross_sell_life_sub", "like", "%UNIVERSAL%"),
    "investment_advisory_cross_sell": ("cross_sell_investment_sub", "in", "INVESTMENT_ADVISORY"),
    "investment_brokerage_cross_sell": ("cross_sell_investment_sub", "in", "INVESTMENT_BROKERAGE"),
}
# ---- end of fixed values ----

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _condition(alternative, fields: dict) -> str | None:
    if alternative[0] == "all":
        parts = [_condition(a, fields) for a in alternative[1:]]
        return None if None in parts else "(" + " AND ".join(parts) + ")"
    field, kind, values = alternative
    name = fields.get(field)
    if name is None:
        return None
    if kind == "in":
        return f"{name} IN (" + ", ".join(_quoted(v) for v in values) + ")"
    return "(" + " OR ".join(f"{name} LIKE {_quoted(v)}" for v in values) + ")"


def any_of(alternatives, fields: dict) -> str:
    """SQL condition that holds when one of the alternatives does; "" when none can."""
    return " OR ".join(c for c in (_condition(a, fields) for a in alternatives) if c)


def first_match(rules, fields: dict, default: str | None = None) -> str:
    """SQL for the label of the first rule that matches. Absent fields cannot match.

    A rule table becomes one expression text, so building it is one call whatever its length.
    """
    whens = [
        f"WHEN {any_of(alternatives, fields)} THEN {_quoted(label)}"
        for label, *alternatives in rules if any_of(alternatives, fields)
    ]
    return f"CASE {' '.join(whens)} ELSE {'NULL' if default is None else _quoted(default)} END"


def _gated(gate, rules, fields, default) -> Column:
    return F.expr(f"CASE WHEN {any_of(gate, fields)} THEN {first_match(rules, fields, default)} END")


def _fields(lob, l1, l2, product) -> dict:
    return {"lob": lob, "level1": l1, "level2": l2, "product": product}


def product_category(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2",
                     product=None, null_when: str | None = None) -> Column:
    """Category from three fields, or four when a product text is given.

    ``null_when`` is a condition that leaves the category null, as for a second policy that
    does not exist.
    """
    label = first_match(CATEGORY_RULES, _fields(lob, l1, l2, product), "OTHER")
    return F.expr(label if null_when is None else f"CASE WHEN NOT coalesce({null_when}, false) THEN {label} END")


def retirement_sub(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return _gated(RETIREMENT_GATE, RETIREMENT_SUB_RULES, _fields(lob, l1, l2, product), "RETIREMENT_OTHER")


def life_sub(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return _gated(LIFE_GATE, LIFE_SUB_RULES, _fields(lob, l1, l2, product), "LIFE_OTHER")


def investment_sub(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return _gated(INVESTMENT_GATE, INVESTMENT_SUB_RULES, _fields(lob, l1, l2, product), "INVESTMENT_OTHER")


def tax_treatment(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return F.expr(first_match(TAX_RULES, _fields(lob, l1, l2, product)))


def investment_type(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return F.expr(first_match(INVESTMENT_TYPE_RULES, _fields(lob, l1, l2, product)))


def account_type(lob="prod_lob", l1="sub_product_level_1", l2="sub_product_level_2", product="product"):
    return F.expr(first_match(ACCOUNT_TYPE_RULES, _fields(lob, l1, l2, product)))


def classify(df: DataFrame, product: str | None = None) -> DataFrame:
    """Add the category; with a product text also the sub-categories and characteristics."""
    if product is None:
        return df.withColumn("product_category", product_category())
    return df.withColumns({
        "product_category": product_category(product=product),
        "retirement_sub_category": retirement_sub(product=product),
        "life_sub_category": life_sub(product=product),
        "investment_sub_category": investment_sub(product=product),
        "tax_treatment": tax_treatment(product=product),
        "investment_type": investment_type(product=product),
        "account_type": account_type(product=product),
    })


def target_flags(df: DataFrame, category: str = "cross_sell_product_category") -> DataFrame:
    """One 0/1 column per sellable category."""
    return df.withColumns({
        f"{c.lower()}_cross_sell": flag(f"{category} = {_quoted(c)}") for c in TARGET_CATEGORIES
    })


def sub_target_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        name: flag(f"{c} {'LIKE' if kind == 'like' else '='} {_quoted(v)}")
        for name, (c, kind, v) in SUB_TARGETS.items()
    })


def merge_classes(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def category_counts(df: DataFrame, column: str = "product_category") -> DataFrame:
    """Rows per category in one row of columns, zero where a category is absent."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.coalesce(F.sum(flag(f"{column} = {_quoted(c)}")), F.lit(0)).alias(c.lower()) for c in CATEGORIES],
    )
