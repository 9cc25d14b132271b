"""Text classifiers.  Each takes Columns and returns a label Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from merchantry.functions.scalars import any_of, lookup

# Ad-naming words, tested in this order.
REMARKETING_WORDS = ("REMARKETING", "RETARGETING", "EXISTING CUSTOMERS")
ACQUISITION_WORDS = ("PROSPECTING", "ACQUISITION", "LOOKALIKE")

# Channel groups kept under their own name or folded.
CHANNEL_FOLD = {
    "Direct": "Direct",
    "Organic Search": "Organic Search",
    "Paid Search": "Paid Search",
    "Paid Social": "Paid Social",
    "Email": "Email / CRM",
    "Referral": "Referral / Affiliates",
    "Affiliates": "Referral / Affiliates",
}

# Words of the source / medium rules.
EMAIL_SOURCE = "klaviyo"
EMAIL_MEDIA = ("email", "e-mail")
PAID_SEARCH_MEDIA = ("cpc", "ppc", "paid", "paidsearch", "paid_search", "paid-search")
SEARCH_ENGINES = ("google", "bing", "yahoo", "duckduckgo", "ecosia")
PAID_SOCIAL_MEDIA = ("paid", "paid_social", "paidsocial", "paid-social", "social")
CLICK_MEDIA = ("cpc", "ppc")
SOCIAL_SITES = ("facebook", "instagram", "tiktok", "pinterest", "linkedin", "snapchat")
SOCIAL_CODES = ("fb", "ig", "meta")
REFERRAL_MEDIA = ("referral", "affiliate", "affiliates")
DIRECT_SOURCE = "(direct)"
DIRECT_MEDIA = ("(none)", "none", "(not set)")

# Sales channel codes of the stock system.
ORDER_CHANNELS = {
    "Shopify": "shopify_dtc",
    "B2B": "b2b",
    "WooCommerce": "woocommerce",
    "Amazon_UK": "amazon_uk",
}

# Throw-away endings and consumer mail domains.
THROWAWAY_ENDINGS = (".fun", ".in.net")
CONSUMER_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp",
    "hotmail.com", "hotmail.co.uk", "outlook.com", "outlook.co.uk",
    "live.com", "live.co.uk", "msn.com", "icloud.com", "me.com", "mac.com",
    "aol.com", "aim.com", "ymail.com", "rocketmail.com",
    "btinternet.com", "btopenworld.com", "blueyonder.co.uk",
    "virginmedia.com", "virgin.net", "sky.com", "ntlworld.com",
    "talktalk.net", "tiscali.co.uk", "mail.com", "gmx.com", "gmx.de", "gmx.co.uk",
    "protonmail.com", "proton.me", "pm.me", "fastmail.com", "fastmail.fm",
    "yandex.com", "yandex.ru", "mail.ru", "rambler.ru", "ukr.net",
    "web.de", "t-online.de", "freenet.de",
    "163.com", "qq.com", "sina.com", "naver.com", "daum.net",
    "orange.fr", "wanadoo.fr", "laposte.net",
)


def _has_word(text: Column, words) -> Column:
    return any_of(text.contains(w) for w in words)


def audience_type(campaign: Column, adset: Column) -> Column:
    """Remarketing wins over acquisition; a null name makes the whole text null."""
    text = F.upper(F.concat(campaign, F.lit(" "), adset))
    return (
        F.when(_has_word(text, REMARKETING_WORDS), "remarketing")
        .when(_has_word(text, ACQUISITION_WORDS), "acquisition")
        .otherwise("other")
    )


def fold_channel(group: Column) -> Column:
    return lookup(group, CHANNEL_FOLD, F.lit("Other"))


def source_medium_channel(source: Column, medium: Column) -> Column:
    """Seven channels out of session source and medium; first rule wins."""
    src, med = F.lower(source), F.lower(medium)
    social_source = _has_word(src, SOCIAL_SITES) | src.isin(*SOCIAL_CODES)
    return (
        F.when(src.contains(EMAIL_SOURCE) | med.isin(*EMAIL_MEDIA), "Email / CRM")
        .when(med.isin(*PAID_SEARCH_MEDIA) & _has_word(src, SEARCH_ENGINES), "Paid Search")
        .when(med.isin(*PAID_SOCIAL_MEDIA) | (med.isin(*CLICK_MEDIA) & social_source), "Paid Social")
        .when(med == "organic", "Organic Search")
        .when(med.isin(*REFERRAL_MEDIA), "Referral / Affiliates")
        .when((src == DIRECT_SOURCE) & med.isin(*DIRECT_MEDIA), "Direct")
        .otherwise("Other")
    )


def brand_intent(term: Column, brand_terms) -> Column:
    """``branded`` when the search term contains any brand word."""
    if not brand_terms:
        return F.lit("non_branded")
    return F.when(_has_word(term, brand_terms), "branded").otherwise("non_branded")


def order_channel(code: Column) -> Column:
    return lookup(code, ORDER_CHANNELS, F.lit("other"))


def business_email(domain: Column) -> Column:
    throwaway = any_of(domain.endswith(e) for e in THROWAWAY_ENDINGS)
    unknown = domain.isNull() | (domain == "")
    return F.when(unknown | throwaway | domain.isin(*CONSUMER_DOMAINS), False).otherwise(True)


def lifetime_segment(orders: Column) -> Column:
    n = F.coalesce(orders, F.lit(0))
    return (
        F.when(n == 0, "no_orders")
        .when(n == 1, "one_time")
        .when(n.between(2, 4), "occasional")
        .otherwise("loyal")
    )
