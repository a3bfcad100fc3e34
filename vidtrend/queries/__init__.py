"""Named queries over the given tables."""

from importlib import import_module

FAMILIES = ("relational", "hashtag_queries", "text_queries", "entity_queries", "creator_queries", "topic_queries",
            "model_queries")


def load():
    from vidtrend.queries import registry
    for family in FAMILIES:
        import_module(f"vidtrend.queries.{family}")
    return registry.QUERIES, registry.ORACLES
