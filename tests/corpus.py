"""A small evidence graph for query tests: every odd value that a rule is about."""

DATA = {
    "collections": {
        "papers": {
            "type": "document",
            "documents": {
                "p1": {"title": "Ants", "field": "bio", "rank": 7.5, "open": True, "tags": ["x", "y"], "meta": {"src": {"kind": "web"}}, "embedding": [1.0, 0.0], "content": "Ants walk in lines"},
                "p2": {"title": "Bees", "field": "bio", "rank": 3, "open": False, "tags": [], "note": None, "embedding": [0.0, 1.0], "content": "Bees dance and walk"},
                "p3": {"title": "Ψάρι", "field": "sea", "rank": -2.5, "tags": ["x"], "blank": "", "embedding": [0.6, 0.8], "content": "  fish  "},
                "p4": {"title": "crabs", "deep": {"list": [4, 1, 4, 2]}},
            },
        },
        "cites": {
            "type": "edge",
            "documents": {
                "c1": {"_from": "papers/p1", "_to": "papers/p2", "relation_type": "cites", "confidence": 0.9},
                "c2": {"_from": "papers/p2", "_to": "papers/p3", "relation_type": "cites", "confidence": 0.5},
                "c3": {"_from": "papers/p1", "_to": "papers/p3", "relation_type": "doubts", "confidence": 0.1},
                "c4": {"_from": "papers/p3", "_to": "papers/p1", "relation_type": "cites", "confidence": 0.7},
            },
        },
        "towns": {"type": "document", "documents": {"a": {"n": "Oslo"}, "b": {"n": "Öland"}, "c": {"n": "Paris"}}},
        "values": {"type": "document", "documents": {"v1": {"v": 5}, "v2": {"v": 5.0}, "v3": {"v": 6}}},
    }
}
