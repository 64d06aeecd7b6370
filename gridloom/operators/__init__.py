"""Operations on arrays, each a lazy plan."""
