"""vellumine.functions"""
