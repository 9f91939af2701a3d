"""Column expressions: URLs, text and element predicates. All of them stay in Catalyst
except ``urls.absolute_url``, which needs RFC 3986 reference resolution."""
