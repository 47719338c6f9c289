from datetime import datetime, timedelta


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def minutes(start: str, count: int, step: float = 1.0) -> list[datetime]:
    first = at(start)
    return [first + timedelta(minutes=i * step) for i in range(count)]


def rows(df, *columns, order=None):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect()) if order is None else [
        tuple(r) for r in picked.orderBy(*order).collect()
    ]
