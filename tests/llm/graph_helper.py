from collections import defaultdict


def components_of(nodes, links):
    """Smallest reachable node of each node, by breadth-first search."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(nodes):
        if n not in root:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = n
                    todo += near[x]
    return root
