"""Fixed values of the data model: word lists, labels and aliases that results depend on."""

# Articles dropped from keys, and company suffixes stripped from their end.
ARTICLES = ["the", "a", "an"]
SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "plc", "gmbh", "ag", "nv", "bv", "sa"]
# First words of mentions too vague for a node.
VAGUE = [
    "other", "others", "various", "many", "several", "some", "multiple", "numerous", "certain", "company", "companies", "country", "countries", "people", "customers", "users", "automakers",
    "manufacturer", "manufacturers", "investors", "government", "authorities", "experts",
]
# Relations that are no relations.
JUNK_RELATIONS = ["IN", "OF", "THE", "IS", "A", "AND"]
# Entity types.
TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "PRODUCT", "EVENT", "MISC"]
# Relations whose repeated edges vote for a type of their tail or head.
PLACE_TAIL = ["LOCATED_IN", "HEADQUARTERED_IN", "BASED_IN"]
OFFICE = ["CEO_OF", "CHIEF_SCIENTIST_OF", "CTO_OF", "CFO_OF"]
COMPANY_HEAD = ["SUBSIDIARY_OF", "ACQUIRED", "INVESTED_IN", "EMPLOYS", "MANUFACTURES", "HEADQUARTERED_IN"]
# Relations between a maker and what it makes.
PRODUCT_RELATIONS = ["MANUFACTURES", "PRODUCES", "MAKES", "SHIPS", "SELLS", "OFFERS", "LAUNCHED", "DEVELOPS", "DESIGNS", "CREATED"]
# Relation labels, known rare relations, and surface forms folded onto labels.
RELATION_LABELS = [
    "no_relation", "CEO_OF", "FOUNDED_BY", "LOCATED_IN", "PARTNER_WITH", "COMPETES_WITH", "ACQUIRED", "SUBSIDIARY_OF", "EMPLOYS", "INVESTED_IN", "MANUFACTURES", "HAS_CEO", "FOUNDED", "ACQUIRED_BY", "PARENT_OF", "EMPLOYED_BY", "MANUFACTURED_BY",
]
UNSUPPORTED = [
    "FOUNDING_MEMBER_OF", "LOANED_TO", "ISSUED", "RAISED", "OPENED_ON", "AUTHORED", "ASSUMED_RESPONSIBILITY_FOR", "FILED_CHARGE_AGAINST", "OWNED", "HAS_SUBSIDIARY", "SUPPLIES", "DEVELOPED", "PRODUCES", "DIVESTED", "SPUN_OFF", "MEMBER_OF", "HAS_PARTNER", "HAS_EMPLOYEE", "INVESTED_BY", "LOCATED_AT",
]
ALIASES = {
    "IS_CEO_OF": "CEO_OF", "CEO_OF_COMPANY": "CEO_OF", "CHIEF_EXECUTIVE_OFFICER_OF": "CEO_OF", "FOUNDER_OF": "FOUNDED", "CO_FOUNDED": "FOUNDED", "WAS_FOUNDED_BY": "FOUNDED_BY", "SUBSIDIARY": "SUBSIDIARY_OF", "IS_SUBSIDIARY_OF": "SUBSIDIARY_OF", "OWNED_BY": "SUBSIDIARY_OF",
    "PARENT": "PARENT_OF", "HEADQUARTERED_IN": "LOCATED_IN", "BASED_IN": "LOCATED_IN", "LOCATED_IN_COUNTRY": "LOCATED_IN", "PARTNERED_WITH": "PARTNER_WITH", "PARTNERS_WITH": "PARTNER_WITH", "COMPETITOR_OF": "COMPETES_WITH", "COMPETES": "COMPETES_WITH", "ACQUIRES": "ACQUIRED",
    "BOUGHT": "ACQUIRED", "PURCHASED": "ACQUIRED", "EMPLOYS_PERSON": "EMPLOYS", "WORKS_FOR": "EMPLOYED_BY", "EMPLOYEE_OF": "EMPLOYED_BY", "INVESTED": "INVESTED_IN", "MAKES": "MANUFACTURES", "PRODUCED_BY": "MANUFACTURED_BY",
}
# Tags of token datasets as entity types.
TAG_TYPES = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "ORGANISATION": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION", "MISC": "MISC"}
