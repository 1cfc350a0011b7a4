"""First-match detection by ordered rules over headers and bodies, and why an answer isn't the page asked for.

Rules are data: pass your own for more. A rule holds if its header is there (and matches) or its body pattern is found; the
first that holds names the system.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BODY_WINDOW = 250_000
CHALLENGE_WINDOW = 20_000


@dataclass(frozen=True)
class Rule:
    """``header`` (lower case) and ``value`` (a pattern, or any value if None), ``body`` (a pattern). Patterns hold in Java's and RE2's dialect."""

    id: str
    label: str
    header: str | None = None
    value: str | None = None
    body: str | None = None
    kind: str = "other"


# Public marks of content systems, in the order they are tried (shops and builders before frameworks, which they may use).
PLATFORM_RULES = (
    Rule("wordpress", "WordPress", body=r"(?i)/wp-(content|includes)/", kind="cms"),
    Rule("shopify", "Shopify", "x-shopid", body=r"cdn\.shopify\.com/", kind="shop"),
    Rule("wix", "Wix", "x-wix-request-id", body=r"static\.wixstatic\.com/", kind="builder"),
    Rule("squarespace", "Squarespace", "server", "(?i)^squarespace", r"static1\.squarespace\.com/", "builder"),
    Rule("webflow", "Webflow", body=r"data-wf-(site|page)=", kind="builder"),
    Rule("drupal", "Drupal", "x-drupal-cache", None, r"(?i)/sites/default/files/|data-drupal-selector=", "cms"),
    Rule("joomla", "Joomla", "x-content-powered-by", "(?i)joomla", r"(?i)content=.joomla", "cms"),
    Rule("typo3", "TYPO3", body=r"(?i)/typo3(temp|conf)/", kind="cms"),
    Rule("magento", "Adobe Commerce", "x-magento-cache-debug", None, r"data-mage-init=|Magento_Theme", "shop"),
    Rule("prestashop", "PrestaShop", "powered-by", "(?i)prestashop", r"(?i)content=.prestashop", "shop"),
    Rule("bigcommerce", "BigCommerce", body=r"\.bigcommerce\.com/s-", kind="shop"),
    Rule("woosalesforce", "Salesforce Commerce", body=r"demandware\.(static|store)", kind="shop"),
    Rule("hubspot", "HubSpot", "x-hs-hub-id", None, r"js\.hs-scripts\.com/", "cms"),
    Rule("ghost", "Ghost", "x-ghost-cache-status", None, r"(?i)content=.ghost", "cms"),
    Rule("aem", "Adobe Experience Manager", body=r"/etc\.clientlibs/", kind="cms"),
    Rule("sitecore", "Sitecore", "x-sitecore-version", None, r"/-/media/[A-Za-z]", "cms"),
    Rule("mediawiki", "MediaWiki", body=r"(?i)content=.mediawiki", kind="cms"),
    Rule("discourse", "Discourse", "x-discourse-route", None, r"(?i)content=.discourse", "forum"),
    Rule("blogger", "Blogger", body=r"(?i)content=.blogger", kind="builder"),
    Rule("substack", "Substack", body=r"substackcdn\.com/", kind="builder"),
    Rule("next", "Next.js", "x-nextjs-cache", None, r"/_next/static/", "framework"),
    Rule("nuxt", "Nuxt", body=r"/_nuxt/", kind="framework"),
    Rule("gatsby", "Gatsby", body=r"id=.___gatsby", kind="framework"),
    Rule("astro", "Astro", body=r"<astro-island|/_astro/", kind="framework"),
    Rule("sveltekit", "SvelteKit", body=r"/_app/immutable/", kind="framework"),
    Rule("remix", "Remix", body=r"__remixContext", kind="framework"),
    Rule("angular", "Angular", body=r"ng-version=", kind="framework"),
    Rule("rails", "Ruby on Rails", body=r"name=.csrf-param", kind="framework"),
    Rule("django", "Django", body=r"csrfmiddlewaretoken", kind="framework"),
)

# Public marks of delivery networks, by headers only.
NETWORK_RULES = (
    Rule("cloudflare", "Cloudflare", "cf-ray", kind="edge"),
    Rule("cloudfront", "Amazon CloudFront", "x-amz-cf-id", kind="edge"),
    Rule("fastly", "Fastly", "x-fastly-request-id", kind="edge"),
    Rule("akamai", "Akamai", "server", "(?i)^akamai", kind="edge"),
    Rule("azure", "Azure Front Door", "x-azure-ref", kind="edge"),
    Rule("imperva", "Imperva", "x-iinfo", kind="edge"),
    Rule("sucuri", "Sucuri", "x-sucuri-id", kind="edge"),
    Rule("bunny", "bunny.net", "server", "(?i)^bunnycdn", kind="edge"),
    Rule("keycdn", "KeyCDN", "server", "(?i)^keycdn", kind="edge"),
    Rule("cdn77", "CDN77", "server", "(?i)^cdn77", kind="edge"),
    Rule("vercel", "Vercel", "x-vercel-id", kind="host"),
    Rule("netlify", "Netlify", "x-nf-request-id", kind="host"),
    Rule("pages", "GitHub Pages", "x-github-request-id", kind="host"),
    Rule("fly", "Fly.io", "fly-request-id", kind="host"),
    Rule("render", "Render", "x-render-origin-server", kind="host"),
    Rule("heroku", "Heroku", "via", "(?i)vegur|heroku", kind="host"),
    Rule("google", "Google Frontend", "server", "(?i)^(gws|google frontend)", kind="host"),
)

# Public marks of pages that answer instead of the one asked for.
CHALLENGE_RULES = (
    Rule("waiting-title", "waiting room", body=r"(?i)<title>[^<]*just a moment"),
    Rule("attention-title", "block page", body=r"(?i)attention required!? *[|] *cloudflare"),
    Rule("cookies-wanted", "script and cookies wanted", body=r"(?i)enable javascript and cookies to continue"),
    Rule("challenge-script", "challenge script", body=r"(?i)cdn-cgi/challenge-platform|cf[_-]chl[_-]|cf-browser-verification"),
    Rule("denied-title", "access denied", body=r"(?i)<title>[^<]*access denied"),
    Rule("akamai-reference", "block page", body=r"(?i)errors[.]edgesuite[.]net|akamai reference *#"),
    Rule("incapsula", "block page", body=r"(?i)_incapsula_resource|incapsula incident id"),
    Rule("captcha-delivery", "captcha", body=r"(?i)captcha-delivery[.]com|datadome"),
    Rule("px-captcha", "captcha", body=r"(?i)px-captcha|perimeterx"),
    Rule("robot-question", "robot question", body=r"(?i)are you a robot|unusual traffic from your"),
    Rule("check-title", "security check", body=r"(?i)<title>[^<]*(security check|bot verification)"),
    Rule("proof-of-work", "proof of work", body=r"(?i)elements[.]nameditem[(] *.solution"),
    Rule("waf-token", "firewall token", body=r"awsWafCookieDomainList|gokuProps"),
    Rule("automated-access", "automated access page", body=r"(?i)api-services-support@amazon[.]com"),
    Rule("client-challenge", "client challenge", body=r"(?i)<title>[^<]*client challenge|/_fs-ch-"),
    Rule("rejected", "request rejected", body=r"(?i)<title>[^<]*request rejected|the requested url was rejected[.] please consult"),
    Rule("busy-title", "server busy", body=r"(?i)<title>[^<]*server busy"),
)


def first_match(rules: Sequence[Rule], body: Column | None = None, headers: Column | None = None, window: int | None = BODY_WINDOW) -> Column:
    """Id of the first rule that holds, else null. ``headers``: map with lower-case names. ``window``: only so many first characters of the body are matched, all of it if None."""
    head = None if body is None else body if window is None else F.substring(body, 1, window)
    found = []
    for r in rules:
        cond = F.lit(False)
        if r.header is not None and headers is not None:
            value = F.try_element_at(headers, F.lit(r.header))
            cond = cond | (value.rlike(r.value) if r.value else F.coalesce(value, F.lit("")) != "")
        if r.body is not None and head is not None:
            cond = cond | head.rlike(r.body)
        found.append(F.when(F.coalesce(cond, F.lit(False)), F.lit(r.id)))
    return F.coalesce(*found)


def labels(spark: SparkSession, rules: Sequence[Rule] = (*PLATFORM_RULES, *NETWORK_RULES)) -> DataFrame:
    """``id``, ``label``, ``kind`` of the rules, as a table to join."""
    return spark.createDataFrame([(r.id, r.label, r.kind) for r in rules], "id string, label string, kind string")


def refusal_kind(status: Column, challenge: Column, text_length: Column, size: Column) -> Column:
    """Why a control answer isn't the page: metered, refused, challenge, stub, else none."""
    return (
        F.when(status == 402, "metered")
        .when(status.isin(403, 429, 451), "refused")
        .when(F.coalesce(challenge, F.lit(False)), "challenge")
        .when((status < 400) & (size < 5000) & (text_length < 100), "stub")
        .otherwise("none")
    )
