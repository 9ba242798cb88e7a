"""Training-data operators over text, pages and conversations.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` applies the operators to the whole tables with production parameters.
"""
