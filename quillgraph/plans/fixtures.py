"""Small rows that meet rules which the tables' facts don't."""

#: (id, head, relation, tail): mentions that meet every rule of the gate.
MENTIONS = [
    (1, "Elon Musk", "CEO_OF", "Tesla, Inc."), (2, "other automakers", "COMPETES_WITH", "Tesla"), (3, "the other automakers", "COMPETES_WITH", "Tesla"), (4, "Tesla", "R", "Tesla"), (5, "Tesla", "R", "Tesla Inc"),
    (6, "x" * 101, "R", "Tesla"), (7, "Tesla", "r" * 61, "BYD"), (8, "Tesla", "in", "Austin"), (9, "Martin Eberhard and Marc Tarpenning", "FOUNDED", "Tesla"), (10, "Ann and Bob", "KNOWS", "Cat and Dan"), (11, "Al and Bo", "R", "Tesla"),
    (12, "Tesla and SolarCity", "OWNS", "Tesla"), (13, "The and Foo Bar", "R", "Tesla"), (14, "A one two three four five six seven eight", "R", "Tesla"), (15, "Company X", "R", "Tesla"), (16, "  ", "R", "Tesla"), (17, "!!!", "R", "Tesla"), (18, "Customer#000000001", "LOCATED_IN", "NATION_0"), (19, "Apple Inc LLC", "is CEO of", "The Bank of the West"), (20, "BP plc", "***", "AT&T"),
]
#: (chunk, head, relation, tail) of a small worked example.
TOY = [
    ("note_1", "Mira Okafor", "DIRECTS", "Lumen Harbour"), ("note_1", "Lumen Harbour", "BASED_IN", "Trondheim"), ("note_2", "Lumen Harbour", "SUPPLIES", "Brightwater Rail"), ("note_3", "Brightwater Rail", "OWNED_BY", "Castell Group"),
    ("note_3", "Brightwater Rail", "BASED_IN", "Leeds"), ("note_4", "Mira Okafor", "ADVISES", "Castell Group"), ("note_5", "Jonas Weil", "AUDITS", "Lumen Harbour"), ("note_6", "Jonas Weil", "LIVES_IN", "Leeds"), ("note_6", "Ida Brandt", "WORKS_AT", "Brightwater Rail"),
]
TOY_SEED = "Lumen Harbour"
#: (seq, head, relation, tail, types) of facts with names beyond ASCII, and the keys that these names must get.
ACCENTED = [
    (500, "Café Müller", "LOCATED_IN", "北京", "ORGANIZATION", "LOCATION"), (501, "CAFE MULLER GmbH", "SUPPLIES", "small ring", "MISC", "PRODUCT"), (502, "Nestlé", "LOCATED_IN", "Zürich", "", "LOCATION"), (503, "Nestlé S.A.", "OWNS", "Café Müller", "ORGANIZATION", "MISC"), (504, "ＴＳＭＣ Ltd.", "LOCATED_IN", "台灣", "ORGANIZATION", "LOCATION"),
]
ACCENTED_KEYS = {"Café Müller": "cafe muller", "北京": "北京", "CAFE MULLER GmbH": "cafe muller", "Nestlé": "nestle", "Zürich": "zurich", "Nestlé S.A.": "nestle s", "ＴＳＭＣ Ltd.": "tsmc", "台灣": "台灣"}
