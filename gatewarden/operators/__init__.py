"""Domain operators: access, graph, identity resolution, features, rules, policies, signals."""
