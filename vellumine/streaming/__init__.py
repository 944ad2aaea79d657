"""vellumine.streaming"""
