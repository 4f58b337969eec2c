"""Operations on training text and web pages; nothing else in the library imports this package."""
